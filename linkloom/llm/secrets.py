"""Secret scans over an incremental ledger of blobs.

Every version of every file is addressed by the SHA-256 of its content. The ledger remembers which
(blob, rule version) pairs were scanned and what was found, so a run scans only pairs it has not
seen: a new commit costs its new blobs, a changed rule costs that rule. Findings are then joined
back to all paths that hold the blob.

All of it is DataFrame work. A rule's matches get their places from its own pieces: ``split``
gives what stands between the matches, ``regexp_extract_all`` the matches, and a running sum of
their lengths the places in code points. Only texts with a match are split.

What is unseen is told from hashes alone; texts that were scanned before don't move while the unseen blobs are few enough to
broadcast their hashes. Copies of a blob are reduced before the shuffle (one text per task and blob). Findings are written to
the ledger first and read back for the join to paths, so that Spark can split a blob with many paths.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: a Java pattern, and a least length of one of its groups (0: the whole match)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    at_least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order that spans of one start are listed.
RULES = (
    Rule("assign", 1, r"""((?i)password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("prefixed", 1, r"(?:gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,})"),
)
#: Rules that make the base counts and digest.
BASE = ("assign", "access", "hex")

#: Unseen blobs whose hashes are broadcast, at most: some 50 MB.
FEW_BLOBS = 500_000


def _matches(rule: Rule, text: Column) -> Column:
    """Per match: characters before it since the last match, its own, and whether it passes."""
    pattern = F.lit(rule.pattern)
    pieces = F.split(text, rule.pattern, -1)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    judged = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else whole
    found = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(whole)).alias("piece"), whole.alias("match"), judged.alias("judged")),
        lambda x: F.struct(F.length(x["piece"]).alias("skip"), F.length(x["match"]).alias("size"), (F.length(x["judged"]) >= rule.at_least).alias("passes")),
    )
    return F.when(text.rlike(rule.pattern), found)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, keys: tuple[str, ...] = ("blob",), text_col: str = "text", pending: str | None = None) -> DataFrame:
    """(keys, rule, start, end) of every match that passes; keys must tell the rows apart.

    ``pending`` names an array column with the keys of the rules to try on a row; without it all are.
    Spans count code points, the end is exclusive; matches of one rule do not overlap. Null: none.
    """
    per_rule = []
    for n, rule in enumerate(rules):
        found = _matches(rule, F.col(text_col))
        if pending:
            found = F.when(F.array_contains(pending, rule.key), found)
        per_rule.append(F.struct(F.lit(n).alias("rule"), found.alias("found")))
    some = F.filter(F.array(*per_rule), lambda x: x["found"].isNotNull())
    by_rule = blobs.select(*keys, F.explode(some).alias("r"))
    matches = by_rule.select(*keys, F.col("r.rule").alias("rule"), F.posexplode("r.found").alias("nth", "m"))
    order = W.partitionBy(*keys, "rule").orderBy("nth")
    end = F.sum(F.col("m.skip").cast("long") + F.col("m.size")).over(order)
    return matches.select(*keys, "rule", end.alias("end"), F.col("m.size").alias("size"), F.col("m.passes").alias("passes")).where("passes").select(*keys, "rule", (F.col("end") - F.col("size")).alias("start"), "end")


class SecretLedger:
    """The ledger: two Parquet folders below ``path``, ``scanned`` (blob, rules) and ``findings``.

    A run appends to both, findings first: if it is lost in between, the next run scans its pairs
    again and readers take distinct findings.
    """

    _SCANNED = "blob binary, rules array<string>"
    _FINDINGS = "blob binary, rule string, start long, end long"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, ddl: str) -> DataFrame | None:
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return None
        return self.spark.read.schema(ddl).parquet(f"{self.path}/{name}")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, rule, start, end) of these rule versions."""
        found = self._read("findings", self._FINDINGS)
        if found is None:
            return self.spark.createDataFrame([], self._FINDINGS)
        return found.where(F.col("rule").isin([r.key for r in rules])).distinct()

    def scan(self, history: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scans what is new in ``history`` (one row per path and version) and returns history's rows with ``blob`` (SHA-256, binary).

        Null text: the empty blob. A column named blob is replaced.
        """
        addressed = history.withColumn("blob", F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
        texts = addressed.select("blob", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        keys = F.array(*[F.lit(r.key) for r in rules])
        seen = self._read("scanned", self._SCANNED)
        if seen is None:
            blobs = texts.groupBy("blob").agg(F.first("text").alias("text"))
            newly = texts.select("blob").distinct()
        else:
            known = seen.groupBy("blob").agg(F.flatten(F.collect_set("rules")).alias("known"))
            unseen = F.array_except(keys, F.coalesce("known", F.array().cast("array<string>")))
            newly = cut(texts.select("blob").distinct().join(known, "blob", "left").select("blob", unseen.alias("pending")).where("size(pending) > 0"), "unseen")
            few = newly.count() <= FEW_BLOBS
            blobs = texts.join(F.broadcast(newly) if few else newly, "blob").groupBy("blob").agg(F.first("text").alias("text"), F.first("pending").alias("pending"))
        names = keys
        found = find_spans(blobs, rules, pending=None if seen is None else "pending").select("blob", F.element_at(names, F.col("rule") + 1).alias("rule"), "start", "end")
        found.write.mode("append").parquet(f"{self.path}/findings")
        newly.select("blob", keys.alias("rules")).write.mode("append").parquet(f"{self.path}/scanned")
        return addressed

    def spans_by_blob(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(blob, spans): all spans of a blob by start and then rule, as (kind, start, end)."""
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        keys = F.array(*[F.lit(r.key) for r in rules])
        found = self.findings(rules).withColumn("n", F.array_position(keys, F.col("rule")).cast("int"))
        listed = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "n", "end"))).alias("all"))
        spans = F.transform("all", lambda x: F.struct(F.element_at(kinds, x["n"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
        return listed.select("blob", spans.alias("spans"))


def scan_secrets(history: DataFrame, ledger_path: str | None = None, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds ``blob`` and ``spans`` (array of kind, start, end) to every row of ``history``.

    Without a ledger path the ledger is a scratch folder, so everything is scanned. Columns of these
    names are replaced; repeated rows each keep their row; an empty table gives none.
    """
    spark = history.sparkSession
    history = history.drop("blob", "spans")
    ledger = SecretLedger(spark, ledger_path or scratch_path(spark, "ledger"))
    addressed = ledger.scan(history, text_col, rules)
    spans = cut(ledger.spans_by_blob(rules), "spans")
    empty = F.array().cast(spans.schema["spans"].dataType)
    return addressed.join(spans, "blob", "left").withColumn("spans", F.coalesce("spans", empty))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (by start; overlaps merged) replaced by its first kind in brackets."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        gap = F.substring(text, (state["at"] + 1).cast("int"), F.greatest(s["start"] - state["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= state["at"], F.concat(F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.concat(state["out"], gap, mark).alias("out"))

    def finish(state: Column) -> Column:
        return F.concat(state["out"], F.substring(text, (state["at"] + 1).cast("int"), F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, finish)).otherwise(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_query(spark, sf_dir: str, ledger_path: str | None = None) -> DataFrame:
    """Counts, digest and spans of every document; with a ledger only blobs and rules that it has not are scanned."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    spans = F.col("spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return scan_secrets(docs, ledger_path).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def _oracle() -> str:
    """The same in DuckDB, whose RE2 has the same leftmost, greedy matches for these patterns."""
    # Either case by classes, as RE2's flag would also take the long s and the Kelvin sign.
    words = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")) + "|[aA][pP][iI]_?[kK][eE][yY]"
    base = rf"(?:{words})[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
    tail = rf"^(?:{words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)$"
    patterns = [(0, "assign", base), *[(n, r.kind, r.pattern) for n, r in enumerate(RULES) if n]]
    least = {r.kind: (r.group, r.at_least) for r in RULES}
    parts = []
    for n, kind, pattern in patterns:
        pattern = pattern.replace("'", "''").replace('\\"', '"')
        long_tail = tail.replace("'", "''").replace('\\"', '"')
        judged = f"regexp_extract(m, '{long_tail}', 1)" if least[kind][0] else "m"
        parts.append(
            f"SELECT doc_id, {n} AS n, '{kind}' AS kind, m, i, length({judged}) >= {least[kind][1]} AS passes, p FROM (SELECT doc_id, unnest(ms) AS m, "
            f"unnest(range(1, len(ms) + 1)) AS i, unnest(string_split_regex(t, '{pattern}')[1:len(ms)]) AS p FROM (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms FROM d) WHERE len(ms) > 0)"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({' UNION ALL '.join(parts)}),
placed AS (SELECT doc_id, n, kind, passes, sum(length(p) + length(m)) OVER (PARTITION BY doc_id, n ORDER BY i) AS e, length(m) AS size FROM found),
listed AS (
  SELECT doc_id, count(*) FILTER (n = 0) AS n_assign, count(*) FILTER (n = 1) AS n_access, count(*) FILTER (n = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || (e - size)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - size, n) FILTER (n < 3), '') AS base,
    string_agg(kind || ':' || (e - size)::BIGINT || ':' || e::BIGINT, ',' ORDER BY e - size, n) AS spans
  FROM placed WHERE passes GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (doc_id)"""


OP6_SQL = _oracle()
