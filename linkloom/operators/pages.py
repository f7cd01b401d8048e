"""The main text of a page by preferred elements, for pages whose structure regular expressions can't follow."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import dictionaries as D

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Texts(HTMLParser):
    """Texts of the elements that each selector picks, and of paragraphs; ignored elements are silent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, list[list[str]]]] = []
        self.found: dict[str, list[list[str]]] = {s: [] for s in (*D.CONTENT_SELECTORS, "p")}

    def _picked(self, tag: str, given: dict) -> list[str]:
        classes = (given.get("class") or "").split()
        names = {tag, f"#{given.get('id')}", *(f".{c}" for c in classes), *(["[role=main]"] if given.get("role") == "main" else [])}
        return [s for s in self.found if s in names]

    def handle_starttag(self, tag, attrs):
        if tag in _VOID:
            return
        given = dict(attrs)
        if tag == "p" and any(t == "p" for t, _, _ in self.open):
            self.handle_endtag("p")
        silent = tag in D.IGNORED_TAGS or bool(set((given.get("class") or "").split()) & set(D.IGNORED_CLASSES))
        texts = []
        for s in self._picked(tag, given):
            self.found[s].append(text := [])
            texts.append(text)
        self.open.append((tag, silent, texts))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        data = " ".join(data.split())
        if data and not any(silent for _, silent, _ in self.open):
            for _, _, texts in self.open:
                for t in texts:
                    t.append(data)


def main_text(page: str | None) -> str:
    """Texts over 100 characters of the first selector that is there; without any, paragraphs over 50."""
    parser = _Texts()
    parser.feed(page or "")
    parser.close()
    whole = lambda parts: " ".join(parts)
    kept: list[str] = []
    for s in D.CONTENT_SELECTORS:
        if parser.found[s]:
            kept = [t for t in map(whole, parser.found[s]) if len(t) > 100]
            break
    return " ".join(kept or [t for t in map(whole, parser.found["p"]) if len(t) > 50])


def main_content(page: Column) -> Column:
    """``main_text`` in Arrow batches."""

    @F.pandas_udf("string")
    def each(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return each(page)
