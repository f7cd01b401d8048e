"""What the operators of this subpackage share: scratch tables, word splitting and 64-bit mixing.

Scratch tables cut lineage. They are Parquet folders below the directory the cluster names in
``spark.checkpoint.dir``; only in local mode, where that may be unset, is a temporary folder made.
A reread scratch table has no lineage, so a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of words in every contract here: blank and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that one Arrow batch may hold, so that a batch of long texts stays small.
ARROW_ROWS = 1000


def scratch_root(spark: SparkSession) -> str:
    """The folder for scratch tables: the session's checkpoint directory."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is not set: executors of {master} share no other folder")
        root = tempfile.mkdtemp(prefix="linkloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def tune(spark: SparkSession) -> None:
    """Smaller Arrow batches than the default, as documents are long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > ARROW_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: a checkpoint in columnar form."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._scratch)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser with full avalanche over 64 bits; returns a new array."""
    x = x ^ (x >> np.uint64(30))
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


class Memo(dict):
    """A word cache that fills itself and starts again when it holds ``limit`` entries."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        value = self[key] = self.make(key)
        return value


def text_blocks(texts: list, size: int = 2_000_000):
    """Runs of rows whose texts have at most about ``size`` characters together."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


@contextmanager
def steady():
    """No cycle collection while a block builds large caches: they hold no cycles, and each pass would walk them all."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


class Bloom:
    """A set of 64-bit keys with false positives, used to ship fewer rows before an exact join.

    It has at most ``most_bits`` bits however many keys there are: with more it lets more through, never less.
    """

    def __init__(self, words: np.ndarray, values: np.ndarray, n_bits: int, probes: int):
        self.n_bits, self.probes = n_bits, probes
        bits = np.zeros(n_bits // 64, np.uint64)
        bits[words] = values
        self.bits = bits

    @staticmethod
    def places(keys: np.ndarray, n_bits: int, i: int) -> np.ndarray:
        y = mix64(keys.astype(np.uint64))
        return (y + np.uint64(i) * ((y >> np.uint64(32)) | np.uint64(1))) & np.uint64(n_bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        found = np.ones(len(keys), bool)
        for i in range(self.probes):
            at = self.places(keys, self.n_bits, i)
            found &= (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return found


def bloom(keys: DataFrame, column: str, most_bits: int = 1 << 28, probes: int = 5) -> Bloom:
    """A Bloom filter over a column of longs, or of binaries that hold packed ones. Tasks set bits, words of bits are combined, and at most ``most_bits`` bits move."""
    n_bits = 1 << 16
    packed = keys.schema[column].dataType.typeName() == "binary"
    wanted = 12 * ((keys.agg(F.sum(F.octet_length(column))).first()[0] or 0) // 8 if packed else keys.count())
    while n_bits < min(wanted, most_bits):
        n_bits *= 2

    def run(batches):
        bits = np.zeros(n_bits // 64, np.uint64)
        for batch in batches:
            some = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64) if packed else np.asarray(batch.column(0)).view(np.uint64)
            for i in range(probes):
                at = Bloom.places(some, n_bits, i)
                np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        words = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64()), pa.array(bits[words].view(np.int64))], names=["word", "value"])

    found = keys.select(column if packed else F.col(column).cast("long")).mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    return Bloom(np.asarray(found.column("word").combine_chunks()), np.asarray(found.column("value").combine_chunks()).view(np.uint64), n_bits, probes)


#: Caches that outlive a task in a Python worker, by the operator they serve.
_CACHES: dict[str, dict] = {}


def kept(owner: str, cache: dict) -> dict:
    """Registers a cache that a worker may keep from task to task."""
    _CACHES[owner] = cache
    return cache


def serve(owner: str) -> None:
    """At a task's start: a worker that served another operator before drops that one's cache, so that they don't add up."""
    others = [c for name, c in _CACHES.items() if name != owner and c]
    for c in others:
        c.clear()
    if others:
        let_go()


def let_go(*broadcasts) -> None:
    """At a task's end: the worker, which waits for its next task, keeps neither broadcast values nor freed pages."""
    for b in broadcasts:
        vars(b).pop("_value", None)
    gc.collect()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
