"""What the corpus operators share: written intermediate tables, sums of arrays, word hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.iterate import cut, drop, drop_path, new_path, release, shared_dir  # noqa: F401

#: Arrays that one task of a merge adds up.
FAN_IN = 16


def summed(parts: DataFrame, column: str, size: int, dtype: str = "int64") -> np.ndarray:
    """Sum of the arrays of ``size`` numbers that the rows hold as bytes, by a tree: a task adds ``FAN_IN`` or so of them, and the
    driver gets one. Arrays travel as ``dtype`` and are added in double precision where that is a fraction."""
    exact = "int64" if np.dtype(dtype).kind in "iu" else "float64"

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(size, exact)
        for batch in batches:
            for x in batch.column(column):
                out += np.frombuffer(x.as_buffer(), dtype)
        yield pa.RecordBatch.from_arrays([pa.array([out.astype(dtype).tobytes()], pa.binary())], names=[column])

    rows, left = parts.select(column), parts.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        rows = rows.repartition(left).mapInArrow(total, f"{column} binary")
    return sum((np.frombuffer(r[column], dtype) for r in rows.collect()), np.zeros(size, exact))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under internal names, so extra columns of the caller can't clash."""
    return df.select(*[df[source].alias(name) for name, source in columns.items()])


#: Ids that are broadcast at most: 8 MB of long numbers. More are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def by_ids(docs: DataFrame, ids: DataFrame, id_col: str, how: str) -> DataFrame:
    """Semi or anti join of ``docs`` with written ``ids``, by a broadcast only where they are few enough."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return docs.join(F.broadcast(ids) if few else ids, id_col, how).select(docs.columns)


def crc_mod(id_col, modulus: int):
    """crc32 of the id as decimal text, modulo ``modulus``: the fold of a labelled row."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)


def uniform(id_col, salt: str):
    """A number in [0, 1) from the id alone, the same on every run and partitioning."""
    return F.pmod(F.xxhash64(F.lit(salt), id_col), F.lit(1 << 30)) / F.lit(float(1 << 30))


# --- hashing of words, vectorised over bytes ---------------------------------------------------

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the public splitmix64 step): spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words where punctuation is to be ignored: all of ASCII but letters and digits.
NOT_ALNUM = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _POWERS or len(_POWERS["up"]) < n:
        size = max(n, 1 << 17)
        for key, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _POWERS[key] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


#: Rows of a batch that are worked on, and sent back, together.
BATCH_ROWS = 1000


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what is made of each stays small whatever Spark's setting."""
    for batch in batches:
        for at in range(0, max(batch.num_rows, 1), BATCH_ROWS):
            yield batch.slice(at, BATCH_ROWS)


#: Bytes of text that are hashed in one go; a longer text goes alone.
CHUNK_BYTES = 1 << 18


def text_chunks(column: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of texts (first row, end row, their bytes, offsets in them); a null text counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    first = 0
    while first < len(column):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        end = min(end, len(column))
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_spans(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (A-Z in lower case), start and end of each word, and words before each text.

    A word is a maximal run of bytes that are not ``between`` words (white space), within one text.
    """
    raw = _LOWER[data] if lower else data
    space = between[data]
    first = np.ones(len(raw) + 1, dtype=bool)
    first[1:] = space
    last = np.append(space, True)[1:]
    cuts = offsets[:-1][offsets[:-1] < len(raw)]
    first[cuts] = True
    last[cuts[cuts > 0] - 1] = True
    start = np.flatnonzero(first[:-1] & ~space)
    end = np.flatnonzero(last & ~space) + 1
    return raw, start, end, np.searchsorted(start, offsets)


def span_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes: a polynomial over them, taken from one prefix sum, then mixed with their number."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[raw] * up[: len(raw)], out=sums[1:])
    return mix(((sums[end] - sums[start]) * down[start]) ^ (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word and the number of words before each text."""
    raw, start, end, before = word_spans(data, offsets, between)
    return span_hashes(raw, start, end), before


def fold(words: np.ndarray, width: int) -> np.ndarray:
    n = len(words) - width + 1
    out = np.full(n, np.uint64(width), dtype=np.uint64)
    for i in range(width):
        out = mix(out * np.uint64(3) + words[i : i + n])
    return out


def shingle_sets(words: np.ndarray, before: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its distinct ``width``-word shingles, as sorted hashes.

    A text of fewer words has its whole sequence as one shingle, an empty one none.
    """
    full = fold(words, width) if len(words) >= width else np.zeros(0, np.uint64)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if b - a >= width:
            ordered = np.sort(full[a : b - width + 1])
            keep = np.ones(len(ordered), dtype=bool)
            np.not_equal(ordered[1:], ordered[:-1], out=keep[1:])
            out.append(ordered[keep])
        else:
            out.append(fold(words[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out
