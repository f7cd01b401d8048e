"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Signatures. Each shingle of a text is an element; in step j an element draws a uniform number r
   and the next place of its own random permutation of the m components, and offers j + r there
   (Ertl, "SuperMinHash", 2017). A text stops as soon as every component has an offer from an
   earlier step, as later steps can't win any more: long texts need two or three steps. The steps
   run for all texts of a block at once in numpy.
2. Texts with one and the same shingle set form a class; only its representative (smallest id) goes on.
   So exact copies, however many, cost one row each and no pair.
3. Bands. Representatives that share a band are candidates. They are not paired: each is tied to the
   smallest of its band (a star), and the connected components of these ties are candidate clusters.
4. Verification. All pairs within a cluster of up to ``chunk`` members are settled in one task
   on the full shingle sets: a sparse product gives every intersection, and union-find the
   components; no pair leaves the task. A larger cluster is dealt into chunks, and rounds compare a
   chunk of pivots with every chunk (tasks of two chunks each); members of one verified component
   need no further comparison, so a clump of near copies is done after the first round. Pivots are
   taken until no cluster has members left that neither were pivots nor joined the rest.
5. Across tasks, union-find is by alternating stars on rows (id, parent): over the ties of step 3, and
   over the spanning forests that the rounds of step 4 return.

No pair list, group or component is ever held by the driver, and no task holds more than two chunks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Memo, cut, drop_scratch, kept, mix64, serve, text_blocks, tune

_WORD_HASHES = kept("minhash", Memo(lambda w: xxhash.xxh3_64_intdigest(w), 500_000))
_U32 = np.uint64(0xFFFFFFFF)


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence where words are fewer; empty without words."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    get = _WORD_HASHES.__getitem__
    h = np.array([get(w) for w in words], np.uint64)
    size = min(k, len(h))
    found = np.full(len(h) - size + 1, size, np.uint64)
    for i in range(size):
        found = mix64(found * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - size + 1 + i])
    return np.unique(found)


def super_minhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """SuperMinHash of n element sets: an n by m array of (step << 32 | uniform 32 bits).

    ``elements`` are distinct within an owner. Sets without elements keep the largest value throughout.
    """
    best = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    elements, owner = elements.astype(np.uint64), owner.astype(np.int64)
    drawn: list[np.ndarray] = []
    with np.errstate(over="ignore"):
        for j in range(m):
            x = mix64(elements + np.uint64((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
            k = np.int64(j) + (((x >> np.uint64(32)) * np.uint64(m - j)) >> np.uint64(32)).astype(np.int64)
            place = k.copy()
            for t in range(j - 1, -1, -1):  # undo the swaps: what stood at k after the earlier steps
                place[place == drawn[t]] = t
            np.minimum.at(best, owner * m + place, (np.uint64(j) << np.uint64(32)) | (x & _U32))
            if j + 1 == m:
                break
            open_ = (best.reshape(n, m) == np.iinfo(np.uint64).max).any(axis=1)
            stay = open_[owner]
            if not stay.any():
                break
            drawn.append(k)
            if not stay.all():
                elements, owner = elements[stay], owner[stay]
                drawn = [d[stay] for d in drawn]
    return best.reshape(n, m)


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band, mixed from its rows and the band's number."""
    n, m = signature.shape
    rows = m // bands
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (n, bands)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r : bands * rows : rows])
    return keys


def _signature_rows(k: int, bands: int, rows: int, at_id: int, at_text: int):
    def run(batches):
        serve("minhash")
        for batch in batches:
            ids, texts = batch.column(at_id), batch.column(at_text).to_pylist()
            for a, b in text_blocks(texts):
                sets = [shingle_set(t, k) for t in texts[a:b]]
                sizes = np.array([len(s) for s in sets], np.int64)
                owner = np.repeat(np.arange(b - a), sizes)
                keys = band_keys(super_minhash(np.concatenate(sets), owner, b - a, bands * rows), bands).view(np.int64)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * bands, bands), pa.int32()), pa.array(keys.reshape(-1)))
                digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes), pa.array(digest, pa.binary()), flat], names=["id", "n_shingles", "digest", "bands"])

    return run


def _set_rows(k: int):
    """(cluster, id, chunk, text) rows to (cluster, id, chunk, sorted set as bytes)."""

    def run(batches):
        serve("minhash")
        for batch in batches:
            sets = [shingle_set(t, k).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("cluster"), batch.column("id"), pa.array(sets, pa.binary())], names=["cluster", "id", "elements"])

    return run


class Forest:
    """Union-find over places 0..n-1; the smaller root stays."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i == j:
            return False
        self.up[max(i, j)] = min(i, j)
        return True


def linked_pairs(sets: list[np.ndarray], percent: int, left: np.ndarray | None = None):
    """Pairs (i, j) with 100 * intersection >= percent * union, in blocks; i from ``left`` if given.

    Elements in one set only can't be shared. The others are counted through the inverted index, or
    by a dense product where an element is in many sets.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    n = len(sets)
    owner = np.repeat(np.arange(n), sizes)
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[code]
    owner, code = owner[keep], (np.cumsum(shared) - 1)[code[keep]]
    width = int(shared.sum())
    if not width:
        return
    order = np.argsort(code, kind="stable")
    by_element = owner[order]
    ends = np.cumsum(np.bincount(code, minlength=width))
    starts = ends - np.bincount(code, minlength=width)
    often = (ends - starts) > 32
    column = np.cumsum(often) - 1
    dense = np.zeros((n, int(often.sum())), np.float32)
    hit = often[code]
    dense[owner[hit], column[code[hit]]] = 1
    row_ends = np.cumsum(np.bincount(owner, minlength=n))
    for i0 in range(0, n if left is None else len(left), 256):
        rows = np.arange(i0, min(n, i0 + 256)) if left is None else left[i0 : i0 + 256]
        both = (dense[rows] @ dense.T).astype(np.int64)
        for at, i in enumerate(rows):
            own = code[(row_ends[i - 1] if i else 0) : row_ends[i]]
            own = own[~often[own]]
            if len(own):
                runs = [by_element[starts[c] : ends[c]] for c in own]
                both[at] += np.bincount(np.concatenate(runs), minlength=n)
        union = sizes[rows][:, None] + sizes[None, :] - both
        ok = 100 * both >= percent * union
        ok &= np.arange(n)[None, :] != rows[:, None]
        yield from zip(rows[np.nonzero(ok)[0]], np.nonzero(ok)[1], strict=True)


def _edges(ids: list[int], sets: list[bytes], percent: int, pivot: list[bool] | None = None):
    """A spanning forest of the links among rows; with ``pivot``, of links that a pivot has."""
    forest = Forest(len(ids))
    arrays = [np.frombuffer(s, np.uint64) for s in sets]
    left = None if pivot is None else np.flatnonzero(np.array(pivot))
    return [(ids[i], ids[j]) for i, j in linked_pairs(arrays, percent, left) if forest.join(int(i), int(j))]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_EDGE_DDL = "a long, b long"


def _edge_table(edges) -> pa.Table:
    return pa.table([pa.array([x[i] for x in edges], pa.int64()) for i in (0, 1)], schema=_EDGE)


#: Edges that one task may hold.
EDGES = 1_000_000


def _local_stars(batches):
    """Edges (node, smallest node of its component) from the edges of one task."""
    up: dict[int, int] = {}

    def root(i: int) -> int:
        path = []
        while (above := up.setdefault(i, i)) != i:
            path.append(i)
            i = above
        for x in path:
            up[x] = i
        return i

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    stars = [(i, r) for i in up if (r := root(i)) != i]
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in stars], pa.int64()) for i in (0, 1)], names=["a", "b"])


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of every node: the smallest id that edges (a, b) reach from it.

    Alternating large and small stars (Kiveris et al., 2014): a large star ties a node's greater
    neighbours to its smallest one, a small star ties the smaller ones and the node to the smallest. A
    round is one job over rows of two numbers, and rounds grow with the logarithm of the longest
    path. Its end is seen from the count and hash sum of the rows it wrote. Before a round, tasks of up
    to ``EDGES`` edges each replace theirs by a star per local component; edges that fit in one task are
    done with that.
    """
    now = edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct()
    now, told = _written(now)
    while True:
        blocks = -(-told[0] // EDGES)
        local, _ = _written(now.coalesce(max(1, blocks)).mapInArrow(_local_stars, _EDGE_DDL))
        drop_scratch(now)
        now = local
        if blocks <= 1:
            break
        both = now.union(now.select("b", "a").toDF("a", "b"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").where("a <> b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").selectExpr("b AS a", "m AS b").union(low.selectExpr("a", "m AS b")).where("a <> b").distinct()
        after, seen = _written(small)
        drop_scratch(now)
        now = after
        if seen == told:
            break
        told = seen
    return nodes.join(now.toDF("id", "component"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _written(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a scratch table, with their count and hash sum, in one job."""
    watch = Observation()
    table = cut(edges.observe(watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("hash")), "edges")
    return table, (watch.get["n"], watch.get["hash"])


def near_duplicates(
    docs: DataFrame,
    shingle_words: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    bands: int = 32,
    rows: int = 6,
    chunk: int = 1500,
) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) of every row.

    Rows are linked whose shingle sets have 100 * intersection >= percent * union. Words are lower-cased
    in A-Z only. Null and empty texts have no shingles and no links. Rows with one id count as one
    document if their sets are equal, and are linked by the smallest text if they are not; each gives
    its own row. Null ids: no links, component null. Ids are whole numbers, as components are named by the smallest; others are an error.
    Only the two columns are read, so other columns' names can't clash. An empty table gives none.
    A pair at the threshold shares no band with probability (1 - s^rows)^bands: below 1e-4 for 0.8 and
    below 1e-6 for 0.85 with these defaults.
    """
    spark = docs.sparkSession
    tune(spark)
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} is not a column of whole numbers")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = cut(
        narrow.mapInArrow(_signature_rows(shingle_words, bands, rows, 0, 1), "id long, n_shingles long, digest binary, bands array<long>"),
        "signatures",
    )
    # One representative per shingle set. A written table on both sides lets Spark split a hot class.
    classes = cut(signed.where("digest IS NOT NULL AND id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("rep")), "classes")
    reps = signed.where("id IS NOT NULL").join(classes.withColumnRenamed("rep", "id"), ["digest", "id"], "left_semi")
    keyed = reps.select("id", F.explode("bands").alias("band"))
    stars = keyed.groupBy("band").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub < last")
    stars = cut(stars.select("band", "hub"), "stars")
    ties = keyed.join(stars, "band").where("id > hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct()
    ties = cut(ties, "ties")
    active = ties.selectExpr("explode(array(a, b)) AS id").distinct()
    clusters = cut(components(active, ties).withColumnRenamed("component", "cluster"), "clusters")
    member = _verified(spark, narrow, clusters, shingle_words, percent, chunk)
    found = classes.join(member, classes.rep == member.id, "left").select("digest", F.coalesce("component", "rep").alias("component"))
    result = signed.join(cut(found, "members"), "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return result.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), (F.col("id") == component).alias("kept"))


def _verified(spark: SparkSession, narrow: DataFrame, clusters: DataFrame, k: int, percent: int, chunk: int) -> DataFrame:
    """(id, component) of the members of candidate clusters, by the links among them."""
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("members"))
    texts = narrow.join(clusters, "id").groupBy("id", "cluster").agg(F.min("text").alias("text"))
    sets = cut(texts.select("cluster", "id", "text").mapInArrow(_set_rows(k), "cluster long, id long, elements binary"), "sets")
    large = cut(sizes.where(F.col("members") > chunk), "large")

    def settle(table: pa.Table) -> pa.Table:
        """A whole cluster: its members with the smallest id of their component."""
        table = table.sort_by("id")
        ids, forest = table.column("id").to_pylist(), Forest(table.num_rows)
        for i, j in linked_pairs([np.frombuffer(s, np.uint64) for s in table.column("elements").to_pylist()], percent):
            forest.join(int(i), int(j))
        return pa.table({"id": table.column("id"), "component": pa.array([ids[forest.root(i)] for i in range(len(ids))], pa.int64())})

    settled = sets.join(large, "cluster", "left_anti").groupBy("cluster").applyInArrow(settle, "id long, component long")
    if large.isEmpty():
        return settled
    # A stable place in the cluster: chunks by hash, as many as the members ask for.
    big = sets.join(large, "cluster").withColumn("chunk", F.pmod(F.xxhash64("id"), F.ceil(F.col("members") / chunk).cast("long")))
    big = cut(big, "big")
    return settled.union(_rounds(big, percent))


def _rounds(big: DataFrame, percent: int) -> DataFrame:
    """(id, component) of the members of clusters that are dealt into chunks, by rounds of pivots."""
    spark = big.sparkSession
    edges = spark.createDataFrame([], _EDGE_DDL)
    left, pivoted = big.select("cluster", "id", "chunk"), None

    def meet(table: pa.Table) -> pa.Table:
        return _edge_table(_edges(table.column("id").to_pylist(), table.column("elements").to_pylist(), percent, table.column("pivot").to_pylist()))

    while True:
        # The pivots of this round: the chunk with the lowest number among members left over.
        turn = left.groupBy("cluster").agg(F.min("chunk").alias("turn"))
        pivots = cut(left.join(turn, "cluster").where("chunk = turn").select("cluster", "id"), "pivots")
        if pivots.isEmpty():
            return components(big.select("id").distinct(), edges)
        chunks = big.select("cluster", "chunk").distinct()
        dealt = pivots.join(big.drop("chunk"), ["cluster", "id"]).join(chunks, "cluster").select("cluster", "chunk", "id", "elements", F.lit(True).alias("pivot"))
        rest = big.join(pivots, ["cluster", "id"], "left_anti").select("cluster", "chunk", "id", "elements", F.lit(False).alias("pivot"))
        edges = cut(edges.union(dealt.union(rest).groupBy("cluster", "chunk").applyInArrow(meet, _EDGE_DDL)), "verified")
        # Left over: neither a pivot so far nor in the component of its cluster that has most members.
        member = cut(components(big.select("id").distinct(), edges), "component")
        grouped = big.select("cluster", "id", "chunk").join(member, "id")
        counts = grouped.groupBy("cluster", "component").count()
        top = counts.groupBy("cluster").agg(F.max(F.struct("count", "component")).alias("top")).select("cluster", "top.component")
        pivoted = cut(pivots if pivoted is None else pivoted.union(pivots), "pivoted")
        left = cut(grouped.join(top, ["cluster", "component"], "left_anti").join(pivoted, ["cluster", "id"], "left_anti").select("cluster", "id", "chunk"), "left")


def op5_query(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents``: three-word shingles, similarity 0.85 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, shingle_words=3, percent=85)
