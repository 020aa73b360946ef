"""Helpers that the operators of this subpackage share: input, folds, durable scratch tables, checked broadcasts."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER, strict=True)}
SPACES = "\x20\x09-\x0d"
BROADCAST_BYTES = 64 << 20
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Spark's own limit is 64 MB: with a few tasks in an executor, buffers of that size on both sides of every Python worker.
BATCH_BYTES = 4 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session.  One is made only where none is set and the session is local (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for the work inside; afterwards it is as it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stored(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    tidy: the shuffle files of the writing go when it has ended, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/quipu/{uuid.uuid4().hex}/{name}"
    with setting(spark, TIDY, "true") if tidy else contextlib.nullcontext():
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes: 8 a column, and what strings, binaries and nested values hold."""
    out = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema:
        kind = field.dataType.typeName()
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif kind in ("array", "map", "struct"):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(field.name))), F.lit(0))
    return out


def small(df: DataFrame, rows: int, size: int = BROADCAST_BYTES) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows and bytes; else df as it is, to be joined by a shuffle."""
    found = df.select(_bytes(df).alias("bytes")).limit(rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    return F.broadcast(df) if found[0] <= rows and found[1] <= size else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def batched(df: DataFrame) -> DataFrame:
    """df, which goes to Python in Arrow batches of at most BATCH_BYTES, or of one row, unless the session has a limit of its own."""
    conf = df.sparkSession.conf
    if conf.get(BATCH) == f"{64 << 20}b":
        conf.set(BATCH, str(BATCH_BYTES))
    return df


def runs(texts: pa.Array, size: int = 1 << 18, rows: int = 1024) -> Iterator[tuple[int, int]]:
    """(first, length) of runs of rows whose texts have at most so many bytes together, or of one row: long texts don't add up in memory."""
    ends, at = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while at < len(texts):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right"))
        to = min(max(at + 1, to), at + rows, len(texts))
        yield at, to - at
        at = to


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each ends; a null text is empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None and held.size else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def held_out(doc_id: Column, n: int) -> Column:
    """Rows that nothing is learnt from: remainder 0, and rows without an id."""
    return F.coalesce(fold(doc_id, n) == 0, F.lit(True))


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; pure ASCII texts take the quick built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def document_key() -> list[Column]:
    """Rows with equal id and text share this key; a null id is told from every id by the hash."""
    return [F.coalesce(F.col("doc_id"), F.lit(-1)).alias("key_id"), F.xxhash64("doc_id", "text").alias("key_hash")]


def share_cut(part: float) -> int:
    """The share of 64-bit hashes below this number is `part`, to the last bit: also 1e-12 of them is not none."""
    return min(int(part * 2.0**64), 2**64 - 1) - 2**63


def share(key: Column, part: float, salt: str = "share") -> Column:
    """Deterministic selection of a share of the keys; selections of different salts are independent."""
    return F.lit(True) if part >= 1 else F.xxhash64(F.lit(salt), key) < F.lit(share_cut(part))
