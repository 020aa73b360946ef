"""Operator 9: media columns.  Netpbm and BMP bytes become numpy arrays, area-resized tiles (NPY) and difference hashes.

Null or undecodable bytes give a null tile and hash and a reason in `error`; nothing is dropped.  A null text is stored as an empty one, one
row of 64 zero samples; a very long one is a tall image, summed a strip at a time.  Equal bytes give equal values, and rows that repeat
each get a row.  Empty tables give no rows.  A column named like the result is replaced, others are kept.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quipu.llm.common import batched, read

STRIP_ROWS = 4096


def _header(data: bytes, count: int) -> tuple[list[int], int]:
    """Netpbm header numbers (comments skipped) and the offset after the one white space that ends them."""
    out, at = [], 2
    while len(out) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as (height, width, channels); bitmaps as 0 and 255, wide samples as uint16."""
    kind = data[:2]
    if kind in (b"P1", b"P4"):
        (w, h), at = _header(data, 2)
        if kind == b"P4":
            row = (w + 7) // 8
            bits = np.unpackbits(np.frombuffer(data, np.uint8, h * row, at).reshape(h, row), axis=1)[:, :w]
        else:
            bits = np.array([c == 49 for c in data[at - 1 :] if c in (48, 49)][: w * h], np.uint8).reshape(h, w)
        return ((1 - bits) * 255).astype(np.uint8)[:, :, None]
    channels = 3 if kind in (b"P3", b"P6") else 1
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not Netpbm")
    (w, h, top), at = _header(data, 3)
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at - 1 :].split()[: w * h * channels], dtype=np.uint16)
    else:
        flat = np.frombuffer(data, ">u2" if top > 255 else np.uint8, w * h * channels, at)
    return flat.reshape(h, w, channels).astype(np.uint16 if top > 255 else np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (palette), 24 or 32 bits, either row order, as RGB."""
    if data[:2] != b"BM":
        raise ValueError("not BMP")
    start, head, w, h, _, bits, packed = struct.unpack_from("<I I i i H H I", data, 10)
    if packed or bits not in (8, 24, 32):
        raise ValueError("unsupported BMP")
    rows, step = abs(h), (w * bits // 8 + 3) // 4 * 4
    grid = np.frombuffer(data, np.uint8, rows * step, start).reshape(rows, step)
    grid = grid[::-1] if h > 0 else grid
    if bits == 8:
        colors = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colors * 4, 14 + head).reshape(colors, 4)
        return palette[grid[:, :w]][:, :, 2::-1].copy()
    size = bits // 8
    return grid[:, : w * size].reshape(rows, w, size)[:, :, 2::-1].copy()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def _at(cumulated: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of an integral at fractional bounds."""
    low = np.minimum(bounds.astype(np.int64), len(cumulated) - 1)
    high = np.minimum(low + 1, len(cumulated) - 1)
    part = (bounds - low).reshape(-1, *[1] * (cumulated.ndim - 1))
    return cumulated[low] * (1 - part) + cumulated[high] * part


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell from the integral image, of which only the rows at cell borders are kept: a strip at a time."""
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    kept, above = np.zeros((height + 1, *image.shape[1:])), np.zeros((1, *image.shape[1:]))
    for y in range(0, h, STRIP_ROWS):
        strip = np.concatenate([above, above + np.cumsum(image[y : y + STRIP_ROWS], axis=0, dtype=np.float64)])
        here = (ys >= y) & (ys <= y + len(strip) - 1)
        kept[here] = _at(strip, ys[here] - y)
        above = strip[-1:]
    across = np.concatenate([np.zeros((height + 1, 1, *kept.shape[2:])), np.cumsum(kept, axis=1)], axis=1)
    cells = np.diff(np.diff(_at(across.swapaxes(0, 1), xs).swapaxes(0, 1), axis=0), axis=1)
    return cells / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits: is each of 8 x 8 cells darker than its right neighbour (grey, 9 x 8 area means)."""
    grey = np.rint(area_resize(image, 8, 9).mean(axis=2) * 256).astype(np.int64)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tile(image: np.ndarray, height: int, width: int) -> bytes:
    out = io.BytesIO()
    np.save(out, np.rint(area_resize(image, height, width)).astype(image.dtype), allow_pickle=False)
    return out.getvalue()


MEDIA = "struct<height:int,width:int,channels:int,tile:binary,dhash:string,error:string>"


def with_media(df: DataFrame, column: str, out: str = "media", height: int = 16, width: int = 16) -> DataFrame:
    """df and a struct column: shape, NPY tile of the given size, difference hash; `error` says why bytes can't be read."""

    @F.arrow_udf(MEDIA)
    def media(values: pa.Array) -> pa.Array:
        rows = []
        for v in values:
            data = v.as_py()
            try:
                if data is None:
                    raise ValueError("null")
                image = decode(data)
                if not image.size:
                    raise ValueError("no pixels")
                rows.append({"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "tile": npy_tile(image, height, width), "dhash": difference_hash(image), "error": None})
            except (ValueError, IndexError, struct.error, OverflowError) as e:
                rows.append({"height": None, "width": None, "channels": None, "tile": None, "dhash": None, "error": str(e)[:80]})
        return pa.array(rows, pa.struct([("height", pa.int32()), ("width", pa.int32()), ("channels", pa.int32()), ("tile", pa.binary()), ("dhash", pa.string()), ("error", pa.string())]))

    return df.withColumn(out, media(F.col(column)))


def text_to_pgm(text: str | None) -> tuple[int, bytes]:
    """Length of the text in bytes, and its padded payload as a grey map 64 samples wide."""
    payload = (text or "").encode()
    rows = max(1, -(-len(payload) // 64))
    return len(payload), b"P5\n64 %d\n255\n" % rows + payload.ljust(rows * 64, b"\0")


STORED = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary()), ("tile_sha256", pa.string())]


def _stored_text(values: pa.Array) -> pa.Array:
    rows = []
    for v in values:
        n, data = text_to_pgm(v.as_py())
        image = decode(data)
        payload, tile = image.tobytes(), npy_tile(image, 16, 16)
        rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), tile, hashlib.sha256(tile).hexdigest()))
    columns = zip(*rows, strict=True) if rows else [[] for _ in STORED]
    return pa.StructArray.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, STORED, strict=True)], [n for n, _ in STORED])


def texts_as_media(docs: DataFrame) -> DataFrame:
    """Each text as a stored grey map, read back: digests of payload and stored form, difference hash, the NPY tile of 16 x 16 samples and its digest."""
    measured = F.arrow_udf(_stored_text, "struct<n_bytes:long,payload_bytes:long,payload_sha256:string,tail_crc32:long,media_bytes:long,media_sha256:string,feature:string,tile:binary,tile_sha256:string>")
    return batched(docs).select("doc_id", measured(F.col("text")).alias("m")).select("doc_id", "m.*")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts_as_media(read(spark, sf_dir, "documents"))
