"""Media columns: Netpbm and BMP images as numpy arrays, area-resized, tiled as NPY, difference-hashed.

Samples of a Netpbm image whose maximum isn't the whole range of a byte (or of two) are scaled to it.

Defined results: a null or empty blob, one that is no image of a known kind, and one that is broken (too few samples, samples above
the maximum, an index beyond the palette, sizes beyond its bytes) gives no tiles, height and width 0, a null hash and a message in ``error``. Repeated rows give repeated, equal rows. Other
columns of the input are left out, so their names can't clash. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from constella.llm import common

#: Rows of an image in one tile, so that one NPY tile of a 64-wide grey image has 256 KB at most.
TILE_ROWS = 4096
#: Width of the grey image that holds a text's payload, and the unit to which payloads are padded.
PAYLOAD_WIDTH = 64


# --- codecs ------------------------------------------------------------------------------------


def _netpbm_fields(data: bytes, count: int) -> tuple[list[int], int]:
    """The first ``count`` numbers of the header (comments skipped) and where they end."""
    out, at = [], 2
    while len(out) < count:
        m = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])*(\d+)").match(data, at)
        if not m:
            raise ValueError("broken Netpbm header")
        out.append(int(m[1]))
        at = m.end()
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as a (height, width) or (height, width, 3) array of uint8 or uint16; bitmaps become 0 and 255."""
    kind = data[:2]
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("no Netpbm image")
    bitmap, colour = kind in (b"P1", b"P4"), kind in (b"P3", b"P6")
    fields, at = _netpbm_fields(data, 2 if bitmap else 3)
    width, height = fields[:2]
    most = 1 if bitmap else fields[2]
    if not 0 < most < 65536:
        raise ValueError("maximum sample out of range")
    shape = (height, width, 3) if colour else (height, width)
    n = math.prod(shape)
    if n > 8 * len(data):
        raise ValueError("more samples than bytes could hold")
    if kind == b"P1":
        digits = re.findall(rb"[01]", re.sub(rb"#[^\n\r]*", b"", data[at:]))
        samples = np.array(digits[:n], dtype=np.uint8)
    elif kind in (b"P2", b"P3"):
        samples = np.array([int(x[:9]) for x in re.sub(rb"#[^\n\r]*", b"", data[at:]).split()[:n]], dtype=np.int64)
    elif kind == b"P4":
        stride = (width + 7) // 8
        rows = np.frombuffer(data, np.uint8, height * stride, at + 1).reshape(height, stride)
        samples = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", n, at + 1)
    if len(samples) != n:
        raise ValueError("too few samples")
    if bitmap:
        return ((1 - samples) * 255).astype(np.uint8).reshape(shape)
    if n and (samples.max() > most or samples.min() < 0):
        raise ValueError("a sample is out of range")
    full = 255 if most < 256 else 65535
    if most != full:
        samples = (samples.astype(np.int64) * (2 * full) + most) // (2 * most)
    return samples.astype(np.uint8 if most < 256 else np.uint16).reshape(shape)


def _masked(pixels: np.ndarray, mask: int) -> np.ndarray:
    """One channel of pixels, scaled to a byte."""
    if not mask:
        return np.zeros(pixels.shape, np.uint8)
    low = (mask & -mask).bit_length() - 1
    most = mask >> low
    return ((((pixels.astype(np.int64) & mask) >> low) * 510 + most) // (2 * most)).astype(np.uint8)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 16, 24 or 32 bits, with channel masks where it has them, as (height, width, 3), or (height, width) with a grey palette."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP image")
    at, header, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if (packing, bits) not in ((0, 1), (0, 4), (0, 8), (0, 16), (0, 24), (0, 32), (3, 16), (3, 32)) or width <= 0 or height == 0:
        raise ValueError("this kind of BMP is not read")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if rows * stride > len(data):
        raise ValueError("more pixels than bytes could hold")
    raw = np.frombuffer(data, np.uint8, rows * stride, at).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits == 16 or packing == 3:
        masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F)
        pixels = np.ascontiguousarray(raw).view("<u2" if bits == 16 else "<u4")[:, :width]
        return np.stack([_masked(pixels, m) for m in masks], axis=2)
    if bits >= 24:
        return raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1].copy()
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    if used > 1 << bits:
        raise ValueError("a palette of too many colours")
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + header).reshape(used, 4)[:, 2::-1]
    if bits == 8:
        index = raw[:, :width]
    else:
        per = 8 // bits
        parts = [(raw >> (8 - bits * (i + 1))) & ((1 << bits) - 1) for i in range(per)]
        index = np.stack(parts, axis=2).reshape(rows, stride * per)[:, :width]
    if index.max() >= used:
        raise ValueError("an index beyond the palette")
    grey = bool((palette == palette[:, :1]).all())
    return palette[index][:, :, 0].copy() if grey else palette[index].copy()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(samples: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


# --- pixels ------------------------------------------------------------------------------------


def _cover(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges of ``m`` equal parts of ``n`` pixels: whole part, next index and the fraction between them."""
    edges = np.arange(m + 1, dtype=np.float64) * n / m
    low = np.minimum(np.floor(edges).astype(np.int64), n)
    return low, np.minimum(low + 1, n), edges - low


def area_resize(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over the exact area of each target pixel, from one integral image read at fractional corners."""
    table = np.zeros((grey.shape[0] + 1, grey.shape[1] + 1))
    np.cumsum(np.cumsum(grey, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    low, high, part = _cover(grey.shape[0], height)
    rows = table[low] * (1 - part)[:, None] + table[high] * part[:, None]
    low, high, part = _cover(grey.shape[1], width)
    corners = rows[:, low] * (1 - part) + rows[:, high] * part
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums / (grey.shape[0] / height * grey.shape[1] / width)


def luminance(image: np.ndarray) -> np.ndarray:
    if image.ndim == 2:
        return image
    return image[..., 0] * 0.299 + image[..., 1] * 0.587 + image[..., 2] * 0.114


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """``size`` rows of ``size`` comparisons of neighbouring cells, as hexadecimal text."""
    cells = np.round(area_resize(luminance(image), size, size + 1), 6)
    bits = np.packbits((cells[:, 1:] > cells[:, :-1]).ravel())
    return bits.tobytes().hex()


def tiles_of(image: np.ndarray, rows: int = TILE_ROWS) -> list[bytes]:
    return [to_npy(image[i : i + rows]) for i in range(0, image.shape[0], rows)]


def image_of(tiles: list[bytes]) -> np.ndarray:
    parts = [from_npy(t) for t in tiles]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


# --- operator ----------------------------------------------------------------------------------

_TILED = "id {id}, width int, height int, tiles array<binary>, hash string, error string"


def media_columns(df: DataFrame, id_col: str, blob_col: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Decode each blob, and return id, width, height, NPY ``tiles`` top to bottom, difference ``hash``, ``error``."""
    source = common.pick(df, id=id_col, blob=blob_col)
    schema = _TILED.format(id=source.schema["id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            out: dict[str, list] = {k: [] for k in ("width", "height", "tiles", "hash", "error")}
            for blob in batch.column("blob"):
                row = (0, 0, [], None, "no image")
                try:
                    image = decode_image(blob.as_py() or b"")
                    if image.size:
                        row = (image.shape[1], image.shape[0], tiles_of(image, tile_rows), difference_hash(image), None)
                except (ValueError, IndexError, OverflowError, struct.error) as problem:
                    row = (0, 0, [], None, str(problem))
                for key, value in zip(out, row, strict=True):
                    out[key].append(value)
            kinds = (pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.string(), pa.string())
            arrays = [pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *arrays], names=["id", *out])

    return source.mapInArrow(run, schema)


def payload_of(text: str | None, unit: int = PAYLOAD_WIDTH) -> tuple[int, bytes]:
    """Length in UTF-8 and the bytes padded with zeros to a positive multiple of ``unit``."""
    data = (text or "").encode("utf-8")
    size = max(unit, -(-len(data) // unit) * unit)
    return len(data), data.ljust(size, b"\0")


def store_text_media(df: DataFrame, id_col: str, text_col: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Texts as images, decoded, tiled and written once to the shared folder; the written table is returned."""
    source = common.pick(df, id=id_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            sizes, tiles = [], []
            for text in batch.column("text"):
                n, data = payload_of(text.as_py())
                image = decode_image(encode_pgm(np.frombuffer(data, np.uint8).reshape(-1, PAYLOAD_WIDTH)))
                sizes.append(n)
                tiles.append(tiles_of(image, tile_rows))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tiles, pa.list_(pa.binary()))], names=["id", "n_bytes", "tiles"]
            )

    kind = source.schema["id"].dataType.simpleString()
    return common.cut(source.mapInArrow(run, f"id {kind}, n_bytes bigint, tiles array<binary>"), "media")


def read_text_media(stored: DataFrame) -> DataFrame:
    """Read stored tiles back and digest them; ``feature`` is the difference hash of the stored image."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows = []
            for cell in batch.column("tiles"):
                tiles = cell.as_py()
                media, image = hashlib.sha256(), image_of(tiles)
                for tile in tiles:
                    media.update(tile)
                data = image.tobytes()
                rows.append(
                    (len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), sum(map(len, tiles)), media.hexdigest(), difference_hash(image))
                )
            arrays = [pa.array(v, t) for v, t in zip(zip(*rows, strict=True) if rows else [()] * 6, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *arrays], names=["doc_id", "n_bytes", *names])

    kind = stored.schema["id"].dataType.simpleString()
    return stored.mapInArrow(
        run,
        f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
    )


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_text_media(store_text_media(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
