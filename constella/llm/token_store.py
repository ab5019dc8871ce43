"""Token ids as canonical length-limited Huffman code, decoded by table in independent blocks.

``write_ids`` tokenises every whole text with a given tokenizer file, appends an end id to each, counts all ids of the
corpus, builds one length-limited code from the counts (package-merge) and writes the coded ids to Parquet files in
ascending order of document id. A row holds one document: its id, its number of ids, its bits, and the bit offset of every
``BLOCK`` ids, so that blocks are decoded independently (here: all blocks of a batch in step). The code lengths are
written beside the rows. ``read_ids`` reads the files back.

Defined results: a null or empty text has the end id alone. Null document ids come first. Rows that repeat an id stand next
to each other in an order that the files fix. An empty table gives files without rows. Extra columns are left out.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constella.llm import common

#: Ids between two checkpoints, the longest code word in bits, and units that a task keeps with their ids.
BLOCK, LONGEST, CACHE = 256, 16, 600_000
#: Bytes of new units that the tokenizer gets as one text.
NEW_BYTES = 1 << 18

#: Texts of other characters than these go to the tokenizer as a whole, since Unicode tables of libraries may differ there.
PLAIN = re.compile("[\\t-\\r\\x20-\\x7e\\xa0-\\u024f\\u2010-\\u2027\\u2030-\\u205e\\u20a0-\\u20bf]*")
_ONLY_SPACE = np.zeros(256, bool)
_ONLY_SPACE[32] = True
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_ALNUM = np.array([i < 128 and chr(i).isalnum() for i in range(256)])
#: Punctuation that starts a piece of its own after a letter or digit; an apostrophe may start a contraction instead.
_MARK = np.array([33 <= i < 127 and not chr(i).isalnum() and chr(i) != "'" for i in range(256)])
#: Bytes of texts that need no closer look: ASCII without control characters, and two-byte letters from U+00C0 on.
_EASY = np.array([9 <= i <= 13 or 32 <= i <= 126 or 0x80 <= i <= 0xBF or 0xC3 <= i <= 0xC8 for i in range(256)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PieceEncoder:
    """Ids of whole texts. Units of a text between which no merge can happen are encoded once and kept by a hash of their bytes.

    A unit is a word with the space before it, or what follows a letter or digit from a punctuation mark on: the tokenizer's pattern
    begins a piece at both places. Texts in which a space adjoins white space or an end, with special tokens or with unusual
    characters, go to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # Ids that begin with a space mark where a unit begins in a text of several.
        vocabulary = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t[0] == "\u0120"]] = True
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint16)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint16) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: np.ndarray, units: list[bytes]) -> None:
        """Encode units (bytes, with their space) and keep their ids under the ascending hashes ``new``."""
        at, size = np.full(len(units), -1, np.int64), np.zeros(len(units), np.int64)
        spaced, stored, base, low = [k for k, u in enumerate(units) if u[0] == 32], [self.store], len(self.store), 0
        while low < len(spaced):
            high, length = low, 0
            while high < len(spaced) and length < NEW_BYTES:
                length += len(units[spaced[high]])
                high += 1
            (coded,) = self._encode([b"".join(units[k] for k in spaced[low:high]).decode()])
            heads = np.flatnonzero(self.spaced[coded])
            if len(heads) == high - low:
                at[spaced[low:high]], size[spaced[low:high]] = base + heads, np.diff(heads, append=len(coded))
                stored.append(coded)
                base += len(coded)
            low = high
        left = np.flatnonzero(at < 0)
        for k, coded in zip(left.tolist(), self._encode([units[k].decode() for k in left.tolist()]), strict=True):
            at[k], size[k] = base, len(coded)
            stored.append(coded)
            base += len(coded)
        place = np.searchsorted(self.hashes, new)
        self.hashes, self.at, self.size = np.insert(self.hashes, place, new), np.insert(self.at, place, at), np.insert(self.size, place, size)
        self.store = np.concatenate(stored)

    def _whole(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Whether each text has to be encoded as a whole."""
        n = len(offsets) - 1
        white, space = _WHITE[data], data == 32
        joined = np.zeros(len(data), bool)
        joined[1:] = (space[1:] & white[:-1]) | (white[1:] & space[:-1])
        filled = np.flatnonzero(offsets[1:] > offsets[:-1])
        first, last = offsets[:-1][filled], offsets[1:][filled] - 1
        joined[first] = space[first] | space[last]
        odd = np.zeros(n, bool)
        odd[np.searchsorted(offsets, np.flatnonzero(joined | ~_EASY[data]), side="right") - 1] = True
        raw = data.tobytes()
        for t in np.flatnonzero(odd).tolist():
            a, b = int(offsets[t]), int(offsets[t + 1])
            # Unusual characters alone may still be harmless.
            odd[t] = bool(joined[a:b].any()) or not PLAIN.fullmatch(raw[a:b].decode()) or bool(re.search(r"\s | \s|^\s|\s$", raw[a:b].decode()))
        for s in self.special:
            at = raw.find(s)
            while at >= 0:
                odd[min(n - 1, int(np.searchsorted(offsets, at, side="right")) - 1)] = True
                at = raw.find(s, at + 1)
        return odd

    def encode(self, data: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of consecutive texts in UTF-8, each with the id ``end`` after it, and their numbers."""
        n = len(offsets) - 1
        odd = self._whole(data, offsets)
        raw, start, stop, before = common.word_spans(data, offsets, _ONLY_SPACE, lower=False)
        # Cut words where a mark follows a letter or digit. Two-byte letters but the signs of times and division count as such.
        letter = _ALNUM[raw]
        two = (raw[:-1] >= 0xC3) & (raw[:-1] <= 0xC8) & (raw[1:] >= 0x80) & ~((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)))
        letter[1:] |= two
        breaks = np.flatnonzero(_MARK[raw[1:]] & letter[:-1]) + 1
        inside = np.searchsorted(start, breaks, side="right") - 1
        keep = (inside >= 0) & (breaks > start[np.maximum(inside, 0)]) & (breaks < stop[np.maximum(inside, 0)]) if len(start) else np.zeros(0, bool)
        breaks = breaks[keep]
        starts = np.sort(np.concatenate([start, breaks]))
        ends = np.sort(np.concatenate([stop, breaks]))
        before = np.searchsorted(starts, offsets)
        spaced = np.zeros(len(starts), bool)
        later = starts > 0
        spaced[later] = raw[starts[later] - 1] == 32
        heads = offsets[:-1][offsets[1:] > offsets[:-1]]
        spaced[np.isin(starts, heads)] = False
        hashes = common.span_hashes(raw, starts, ends) ^ np.where(spaced, np.uint64(0), np.uint64(0xA5A5A5A5A5A5A5A5))
        ours = ~np.repeat(odd, np.diff(before))
        unique, where, back = np.unique(hashes[ours], return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, unique)
        known = np.zeros(len(unique), bool)
        there = place < len(self.hashes)
        known[there] = self.hashes[place[there]] == unique[there]
        if len(self.hashes) + np.count_nonzero(~known) > CACHE:
            # What this run of texts doesn't need makes room; frequent units are in every run.
            self._keep(place[known])
        if not known.all():
            fresh = np.flatnonzero(ours)[where[~known]]
            low = (starts - spaced)[fresh].tolist()
            text = raw.tobytes()
            self._learn(unique[~known], [text[a:b] for a, b in zip(low, ends[fresh].tolist(), strict=True)])
        place = np.searchsorted(self.hashes, unique)[back]
        at, size = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        at[ours], size[ours] = self.at[place], self.size[place]
        # Whole texts and end ids are further units: where each stands is the number of units before it.
        wholes = np.flatnonzero(odd)
        text = raw.tobytes()
        coded = self._encode([text[int(offsets[t]) : int(offsets[t + 1])].decode() for t in wholes.tolist()])
        store = np.concatenate([self.store, *coded, np.array([end], np.uint16)])
        lengths = np.array([len(c) for c in coded], np.int64)
        extra_at = np.concatenate([len(self.store) + np.cumsum(lengths) - lengths, np.full(n, len(store) - 1)])
        extra_size = np.concatenate([lengths, np.ones(n, np.int64)])
        spot = np.concatenate([before[wholes], before[1:]])
        order = np.argsort(np.concatenate([np.zeros(len(wholes)), np.ones(n)]) + 2.0 * np.concatenate([wholes, np.arange(n)]), kind="stable")
        at = np.insert(at, spot[order], extra_at[order])
        size = np.insert(size, spot[order], extra_size[order])
        total = np.cumsum(size)
        ids = store[np.repeat(at - (total - size), size) + np.arange(int(total[-1]) if len(total) else 0)]
        units = np.diff(before) + 1 + odd
        return ids, np.diff(np.concatenate([[0], total[np.cumsum(units) - 1]]))

    def _keep(self, rows: np.ndarray) -> None:
        size = self.size[rows]
        store = self.store[np.repeat(self.at[rows] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        self.hashes, self.at, self.size, self.store = self.hashes[rows], np.cumsum(size) - size, size, store


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceEncoder:
    """One encoder for all tasks of a worker, so that its units are learned once."""
    return PieceEncoder(path)


# --- the code ----------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits for the symbols that occur (0 for others), by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(n))))
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    levels, packages = [], np.zeros(0, np.int64)
    for _ in range(longest):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        levels.append(rank < n)
        merged = merged[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * n - 2
    for leaf in reversed(levels):
        leaves = int(np.count_nonzero(leaf[:take]))
        out[order[:leaves]] += 1
        take = 2 * (take - leaves)
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of (length, symbol), as numbers."""
    out = np.zeros(len(lengths), np.uint32)
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    if not len(symbols):
        return out
    bits = lengths[symbols].astype(np.int64)
    widest = int(bits.max())
    starts = np.cumsum(np.int64(1) << (widest - bits)) - (np.int64(1) << (widest - bits))
    out[symbols] = (starts >> (widest - bits)).astype(np.uint32)
    return out


def decoding_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next bits, and how many bits that are."""
    widest = max(1, int(lengths.max(initial=0)))
    symbols = np.flatnonzero(lengths)
    symbols = symbols[np.lexsort((symbols, lengths[symbols]))]
    spread = np.int64(1) << (widest - lengths[symbols].astype(np.int64))
    table = np.zeros(1 << widest, np.int64)
    bits = np.ones(1 << widest, np.int64)
    table[: spread.sum()] = np.repeat(symbols, spread)
    bits[: spread.sum()] = np.repeat(lengths[symbols].astype(np.int64), spread)
    return table, bits, widest


def encode_rows(ids: np.ndarray, sizes: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Bits of consecutive rows of ``sizes`` ids, each starting at a whole word of 32 bits, and each row's checkpoints."""
    # Code words at the upper end of 64 bits; each is moved down to its place in its word and the next one.
    upper = codes.astype(np.uint64) << ((np.uint64(64) - lengths.astype(np.uint64)) & np.uint64(63))
    total = np.zeros(len(ids) + 1, np.int64)
    np.cumsum(lengths.take(ids), out=total[1:])
    row_end = np.cumsum(sizes)
    row_start = row_end - sizes
    row_bits = total[row_end] - total[row_start]
    row_words = -(-row_bits // 32)
    word_at = np.cumsum(row_words) - row_words
    place = total[:-1] + np.repeat(word_at * 32 - total[row_start], sizes)
    buffer = np.zeros(int(row_words.sum()) + 1, np.uint32)
    if len(ids):
        word = place >> 5
        heads = np.concatenate([[0], np.flatnonzero(word[1:] != word[:-1]) + 1])
        place &= 31
        pairs = np.bitwise_or.reduceat(upper.take(ids) >> place.view(np.uint64), heads)
        buffer[word[heads]] |= (pairs >> np.uint64(32)).astype(np.uint32)
        buffer[word[heads] + 1] |= (pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    raw = buffer.astype(">u4").tobytes()
    blobs = [raw[4 * w : 4 * w + -(-b // 8)] for w, b in zip(word_at.tolist(), row_bits.tolist(), strict=True)]
    marks = [(total[a:b:BLOCK] - total[a]).astype(np.int32) for a, b in zip(row_start.tolist(), row_end.tolist(), strict=True)]
    return blobs, marks


def decode_rows(blobs: list[bytes], sizes: np.ndarray, marks: list[np.ndarray], table: np.ndarray, bits: np.ndarray, widest: int) -> np.ndarray:
    """Ids of all rows in order; every block of every row is decoded in step with the others."""
    sizes = np.asarray(sizes, np.int64)
    start = np.cumsum([0, *[len(b) for b in blobs]])
    data = np.frombuffer(b"".join(blobs) + b"\0" * 8, np.uint8).astype(np.uint32)
    ahead = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    blocks = np.array([len(m) for m in marks], np.int64)
    row = np.repeat(np.arange(len(blobs)), blocks)
    position = (np.concatenate(marks).astype(np.int64) if len(row) else np.zeros(0, np.int64)) + start[:-1][row] * 8
    nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    left = np.minimum(sizes[row] - nth * BLOCK, BLOCK)
    out_at = (np.cumsum(sizes) - sizes)[row] + nth * BLOCK
    out = np.zeros(int(sizes.sum()), np.uint32)
    order = np.argsort(-left, kind="stable")
    position, left, out_at = position[order], left[order], out_at[order]
    shift, mask = 32 - widest, (1 << widest) - 1
    active = len(order)
    for step in range(int(left.max(initial=0))):
        while active and left[active - 1] <= step:
            active = int(np.searchsorted(-left, -step, side="left"))
        p = position[:active]
        peek = (ahead[p >> 3].astype(np.int64) >> (shift - (p & 7))) & mask
        out[out_at[:active] + step] = table[peek]
        p += bits[peek]
    return out


# --- operators ---------------------------------------------------------------------------------


def _planes(ids: bytes) -> bytes:
    """Low bytes, then high bytes: this packs better."""
    pairs = np.frombuffer(ids, np.uint8).reshape(-1, 2)
    return pairs.T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, np.uint8).reshape(2, -1)
    return halves[0] | (halves[1].astype(np.uint16) << 8)


def tokenise(source: DataFrame, make: Callable[[], PieceEncoder], end_id: int, n_symbols: int) -> DataFrame:
    """Ids of each text, and one more row for each task with its counts of ids."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, counts, schema = make(), np.zeros(n_symbols, np.int64), None
        for batch in common.sliced(batches):
            planes, n = [], []
            for _, _, data, offsets in common.text_chunks(batch.column("text")):
                ids, sizes = encoder.encode(data, offsets, end_id)
                counts += np.bincount(ids, minlength=n_symbols)
                raw, at = ids.astype("<u2").tobytes(), 0
                for size in sizes.tolist():
                    planes.append(_planes(raw[at : at + 2 * size]))
                    at += 2 * size
                n += sizes.tolist()
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(planes, pa.binary()), pa.nulls(len(n), pa.binary())], names=["doc_id", "n", "planes", "counts"]
            )
            schema = out.schema
            yield out
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, counts.tobytes()), schema, strict=True)], schema=schema)

    return source.mapInArrow(run, f"doc_id {kind}, n int, planes binary, counts binary")


def id_counts(tokens: DataFrame, n_symbols: int) -> np.ndarray:
    """Counts of all ids of the corpus."""
    return common.summed(tokens.where("counts is not null"), "counts", n_symbols)


def _bounds(tokens: DataFrame, parts: int) -> list:
    """Upper document ids of about equal ranges, in order; an id of very many rows is the bound of several."""
    share = [i / parts for i in range(1, parts)]
    row = tokens.where("doc_id is not null").agg(F.percentile_approx("doc_id", share, 10000).alias("b")).first() if share else None
    return sorted(row["b"]) if row and row["b"] else []


def write_ids(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0) -> None:
    """Write the coded ids of every text to ``path``/rows and the code lengths to ``path``/code."""
    spark = df.sparkSession
    tokenizer = tokenizer or default_tokenizer()
    from tokenizers import Tokenizer

    n_symbols = Tokenizer.from_file(tokenizer).get_vocab_size()
    if n_symbols > 65536:
        raise ValueError("ids of more than 16 bits aren't stored")
    source = common.pick(df, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    written = common.cut(tokenise(source, lambda: _encoder(tokenizer), end_id, n_symbols), "ids")
    lengths = code_lengths(id_counts(written, n_symbols))
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytes(lengths),)], "lengths binary").coalesce(1).write.parquet(f"{path}/code")
    tokens = written.where("counts is null").select("doc_id", "n", "planes", F.monotonically_increasing_id().alias("row"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(tokens, parts)
    held = spark.sparkContext.broadcast((lengths, codes))
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits_of, code_of = held.value
        for batch in common.sliced(batches):
            rows = [_from_planes(x.as_buffer()) for x in batch.column("planes")]
            sizes = np.array([len(r) for r in rows], np.int64)
            blobs, marks = encode_rows(np.concatenate(rows) if rows else np.zeros(0, np.int64), sizes, bits_of, code_of)
            keys = batch.column("doc_id")
            where = []
            for k, row in zip(keys.to_pylist(), batch.column("row").to_pylist(), strict=True):
                low = 0 if k is None else bisect_left(bounds, k)
                # Rows of an id that fills several ranges may stand in any of them.
                high = low if k is None else max(low, bisect_right(bounds, k) - 1)
                where.append(low + row % (high - low + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), keys, batch.column("n"), pa.array(blobs, pa.binary()), pa.array(marks, pa.list_(pa.int32()))],
                names=["range", "doc_id", "n", "bits", "marks"],
            )

    coded = tokens.mapInArrow(run, f"range int, doc_id {kind}, n int, bits binary, marks array<int>")
    # Each range is one file, and files are named in the order of their ranges.
    ordered = coded.repartitionById(parts, F.col("range")).sortWithinPartitions("doc_id")
    ordered.withColumn("row", F.monotonically_increasing_id()).write.option("compression", "uncompressed").parquet(f"{path}/rows")
    common.drop(written)


def read_ids(spark: SparkSession, path: str, per_row: Callable[[np.ndarray], object], schema_of_result: str, arrow_type: pa.DataType) -> DataFrame:
    """range, row, doc_id, n and ``result``: what ``per_row`` makes of each document's decoded ids."""
    rows = spark.read.parquet(f"{path}/rows")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/code").first()["lengths"], np.uint8)
    held = spark.sparkContext.broadcast(decoding_table(lengths))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bits, widest = held.value
        for batch in common.sliced(batches):
            sizes = batch.column("n").to_numpy().astype(np.int64)
            marks = batch.column("marks")
            values, offsets = marks.flatten().to_numpy(), np.cumsum([0, *[len(m) for m in marks]])
            parts = [values[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            ids = decode_rows(batch.column("bits").to_pylist(), sizes, parts, table, bits, widest)
            ends = np.cumsum(sizes)
            result = [per_row(ids[a:b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("range", "row", "doc_id", "n")], pa.array(result, arrow_type)], names=["range", "row", "doc_id", "n", "result"]
            )

    return rows.mapInArrow(run, f"range int, row bigint, doc_id {kind}, n int, result {schema_of_result}")


def ids_of(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids of every document."""
    return read_ids(spark, path, lambda ids: ids.tolist(), "array<int>", pa.list_(pa.int32())).select("doc_id", F.col("result").alias("ids"))


def with_starts(rows: DataFrame) -> DataFrame:
    """``start``: ids of all documents before this one. Totals of the ranges (one for each file) are summed first."""
    totals = rows.groupBy("range").agg(F.sum("n").alias("total"))
    before = totals.select("range", (F.sum("total").over(Window.orderBy("range")) - F.col("total")).alias("before"))
    within = F.sum("n").over(Window.partitionBy("range").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("within", within).join(F.broadcast(before), "range").withColumn("start", (F.col("within") + F.col("before")).cast("bigint"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-files")
    write_ids(common.table(spark, sf_dir, "documents"), path)
    found = common.cut(read_ids(spark, path, lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), "bigint", pa.int64()), "decoded")
    common.drop_path(spark, path)
    return with_starts(found).select("doc_id", "start", F.col("n").cast("bigint").alias("n_tokens"), F.col("result").alias("ids_crc32"))
