"""Points in time that users write: durations back from now, and dates."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

PATTERNS = ("%Y-%m-%d", "%Y/%m/%d", "%d-%m-%Y", "%d/%m/%Y")


def since(said: str, now: datetime) -> datetime:
    """``7d``, ``2w`` or ``12h`` before now, or a date."""
    said = said.strip().lower()
    if m := re.fullmatch(r"(-?\d+)([dwh])", said):
        unit = {"d": "days", "w": "weeks", "h": "hours"}[m[2]]
        return now - timedelta(**{unit: int(m[1])})
    try:
        return datetime.fromisoformat(said)
    except ValueError:
        pass
    for pattern in PATTERNS:
        try:
            return datetime.strptime(said, pattern)
        except ValueError:
            continue
    raise ValueError(f"neither a duration nor a date: {said}")
