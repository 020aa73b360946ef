"""What a folder of tables holds, read from footers and files: columns, types, row counts, digests."""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import re
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import cache, reduce

import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def columns_of(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """(table_name, place, column_name, type, nullable) from the footers; places count from 1."""
    rows = [(t, n, f.name, f.dataType.simpleString(), f.nullable) for t in tables for n, f in enumerate(spark.read.parquet(f"{folder}/{t}.parquet").schema.fields, 1)]
    return spark.createDataFrame(rows, "table_name string, place int, column_name string, type string, nullable boolean")


def row_counts(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """(table_name, rows): one union of counts that asks for no column, so the footers' row counts answer it and no page is read."""
    counts = [spark.read.parquet(f"{folder}/{t}.parquet").agg(F.lit(t).alias("table_name"), F.count(F.lit(1)).alias("rows")) for t in tables]
    return reduce(DataFrame.unionByName, counts)


def catalogue(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """Columns with the row count of their table."""
    return columns_of(spark, folder, tables).join(row_counts(spark, folder, tables), "table_name")


#: Files of at most so many bytes are one value in one task.
WHOLE = 128 << 20
#: Endings by which Spark's text reader would decompress a file.
PACKED = r"\.(gz|bz2|deflate|lz4|snappy|zst|zstd|lzo|xz|passthrough)$"
FEWEST = "spark.sql.files.minPartitionNum"
BOM = b"\xef\xbb\xbf"


class _State(ctypes.Structure):
    """OpenSSL's SHA256_CTX: a digest that is not finished, as bytes that another task can go on from (hashlib gives out none)."""

    _fields_ = [("h", ctypes.c_uint32 * 8), ("bits", ctypes.c_uint32 * 2), ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("size", ctypes.c_uint)]


@cache
def _crypto() -> ctypes.CDLL | None:
    """The OpenSSL that hashlib uses, or the system's."""
    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        try:
            lib = ctypes.CDLL(name)
            lib.SHA256_Init.argtypes, lib.SHA256_Final.argtypes = [ctypes.c_void_p], [ctypes.c_char_p, ctypes.c_void_p]
            lib.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            return lib
        except (OSError, AttributeError):
            continue
    return None


def _begun(data: bytes) -> bytes:
    state = _State()
    _crypto().SHA256_Init(ctypes.byref(state))
    return _more(bytes(state), data)


def _more(state: bytes, data: bytes) -> bytes:
    held = _State.from_buffer_copy(state)
    _crypto().SHA256_Update(ctypes.byref(held), data, len(data))
    return bytes(held)


def _ended(state: bytes) -> str:
    held, out = _State.from_buffer_copy(state), ctypes.create_string_buffer(32)
    _crypto().SHA256_Final(out, ctypes.byref(held))
    return out.raw.hex()


def _exact(path: str) -> str:
    """The path as a pattern that only it matches."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def _digest_by_pieces(spark: SparkSession, path: str, length: int, head: bytes = b"") -> str:
    """SHA-256 of a file that no task reads whole: a job for each piece of it, in order, goes on from the state of the one before.

    The pieces are the partitions of Spark's text reader, with line feeds as the only separators and lines as plain bytes.  It leaves out
    a byte order mark at the start; if these bytes are missing in the end, they are the head of a second reading.
    """
    lines = spark.read.text(_exact(path), lineSep="\n").select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("at"))
    state, seen, last = _begun(head), len(head), -1

    def carried(state: bytes, seen: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, total, at, first = state, seen, last, True
            for b in filter(len, batches):
                begins = b.column("at").to_numpy()
                if begins[0] != begins[-1] or (begins[0] <= at if first else begins[0] != at):
                    raise ValueError(f"the pieces of {path} are not in order")
                data = b"\n".join([*([b""] if at >= 0 else []), *b.column("line").to_pylist()])
                now, total, at, first = _more(now, data), total + len(data), int(begins[0]), False
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([total]), pa.array([at])], ["state", "seen", "last"])

        return run

    for piece in range(lines.rdd.getNumPartitions()):
        step = lines.mapInArrow(carried(state, seen, last), "state binary, seen long, last long")
        ((state, seen, last),) = spark.sparkContext.runJob(step.rdd, list, [piece])
        state = bytes(state)
    if seen == length - 1:
        state, seen = _more(state, b"\n"), length
    if seen == length:
        return _ended(state)
    if not head and length - seen in (len(BOM), len(BOM) + 1):
        return _digest_by_pieces(spark, path, length, BOM)
    raise ValueError(f"{path} has {length} bytes, but {seen} were read")


def file_digests(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, bytes, sha256) of each file of the paths, by its bytes.

    A file of more than WHOLE bytes is read by pieces, one after the other, and its digest is made when this is called.  A longer one with
    an ending of PACKED, or where there is no OpenSSL, is one value in one task all the same: under 2 GB each.  A line of a
    file (up to a line feed) is one value too.  Spark's readers leave out empty files.
    """
    values = spark.read.format("binaryFile")
    name = F.regexp_extract("path", "([^/]+)$", 1).alias("file")
    whole = lambda files: files.select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    files = values.load(list(paths))
    long = files.filter(F.col("length") > WHOLE).select("path", name, "length").collect()
    pieces = [r for r in long if _crypto() and not re.search(PACKED, r.path)]
    if not pieces:
        return whole(files)
    fewest = spark.conf.get(FEWEST, None)
    spark.conf.set(FEWEST, "1")  # a job for each piece: not as many as there are cores
    try:
        with ThreadPoolExecutor(8) as pool:
            digests = list(pool.map(inheritable_thread_target(spark)(lambda r: _digest_by_pieces(spark, r.path, r.length)), pieces))
    finally:
        spark.conf.unset(FEWEST) if fewest is None else spark.conf.set(FEWEST, fewest)
    out = whole(files.filter(F.col("length") <= WHOLE)).unionByName(spark.createDataFrame([(r.file, r.length, d) for r, d in zip(pieces, digests, strict=True)], "file string, bytes long, sha256 string"))
    rest = [_exact(r.path) for r in long if r not in pieces]
    return out.unionByName(whole(values.load(rest))) if rest else out
