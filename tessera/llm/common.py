"""Helpers shared by the training-data operators: shared storage, Arrow batches, word and line conventions."""

from __future__ import annotations

import contextlib
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every operator here: space and the ASCII controls tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
#: Texts are handled in groups of about this many bytes, so that a task's arrays stay small.
GROUP_BYTES = 2_000_000
#: Rows and bytes in an Arrow batch; long texts make larger rows than Spark's default of 10,000 allows for.
BATCH_ROWS = 4096
BATCH_BYTES = 8_000_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: A session's own setting: where its tables go for the time being. Whoever sets it to a folder below the shared one can remove them all at once.
OWN = "spark.tessera.folder"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share, or the session's own one below it (OWN).

    Where neither is set, a temporary one in local mode, where one process does all; an error on a cluster.
    """
    where = spark.conf.get(OWN, None) or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set(OWN, where)
    if "://" not in where and not where.startswith("file:"):  # as Spark's own writers read it
        path = spark._jvm.org.apache.hadoop.fs.Path(where)
        where = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    if where.startswith("file:/") and not where.startswith("file://"):
        where = "file://" + where[5:]
    return where.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = new_folder(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discarded(*tables: DataFrame) -> None:
    """Removes written tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows and bytes for the plans that are executed within; the session's own settings come back after it."""
    own = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, str(v))
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def per_worker[T](key: tuple, make: Callable[[], T]) -> T:
    """What is costly to open, kept for the life of a Python worker, which runs one task after another.

    It hangs on sys, as functions that travel by value have module globals of their own in every task.
    """
    held = sys.__dict__.setdefault("_tessera_worker", {})
    if key not in held:
        held[key] = make()
    return held[key]


def table_bytes(df: DataFrame) -> int:
    """About what the rows of df take: letters of strings, 8 bytes for a number, 8 for an array's number or its JSON's letters."""
    size = F.lit(0).cast("long")
    for field in df.schema:
        c, kind = F.col(f"`{field.name}`"), field.dataType.simpleString()
        if kind in ("string", "binary"):
            width = F.octet_length(c)
        elif kind in ("array<int>", "array<bigint>"):
            width = 8 * F.size(c)
        else:
            width = F.lit(8) if "<" not in kind else F.octet_length(F.to_json(F.struct(c)))
        size = size + F.coalesce(width.cast("long"), F.lit(0)) + 8
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()["bytes"]


#: Tables of up to so many bytes are sent to every executor; larger ones are joined by shuffle.
BROADCAST_BYTES = 32_000_000


def sent(df: DataFrame, most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df (a written table), to be sent to every executor in a join if it is measured to take at most most_bytes."""
    return F.broadcast(df) if table_bytes(df) <= most_bytes else df


def matched(rows: DataFrame, table: DataFrame, key: str | list[str], most_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """rows joined with table by key, through a shuffle of the rows that have a partner.

    If the keys of table (a written one) are measured to take at most most_bytes, they alone go to every executor first and pick those rows.
    """
    names = [key] if isinstance(key, str) else key
    keys = table.select(*names)
    if table_bytes(keys) <= most_bytes:
        rows = rows.join(F.broadcast(keys.distinct()), names, "left_semi")
    return rows.join(table, names)


def text_groups(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of rows of about GROUP_BYTES: first row, end row, their UTF-8 bytes, offsets of each text in them.

    A null text counts as empty; a row that is larger than GROUP_BYTES is a group of its own.
    """
    texts = batch.column(column)
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = pc.cast(texts, pa.large_string())
    if len(texts) == 0:
        return
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64, count=len(texts) + texts.offset + 1)[texts.offset :]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None and texts.buffers()[2].size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + GROUP_BYTES, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte ranges [start, end) of the words of several texts, and for each text the index of its first word (plus the total)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~_BLANK[data]
    cut = np.zeros(n + 1, dtype=bool)  # a text begins here
    cut[offsets] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | cut[1:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | cut[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(base, -1, 1 << 64)
        both = []
        for b in (base, inverse):
            x = np.full(size, b, dtype=np.uint64)
            x[0] = 1
            both.append(np.cumprod(x, dtype=np.uint64))
        _POWERS[base] = both[0], both[1]
    return _POWERS[base]


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two rounds of shift, exclusive-or and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """A polynomial hash of values[start:end] for each range, in O(values + ranges)."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], dtype=np.uint64, out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = BASES[0]) -> np.ndarray:
    return range_hashes(data.astype(np.uint64) + np.uint64(1), starts, ends, base)
