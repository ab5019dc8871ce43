"""Benchmark decontamination by latent semantic retrieval, confirmed by longest common subsequences.

Words (runs of letters, digits and bytes beyond ASCII, A-Z in lower case) are hashed to 16 bits. Passages of 32 words of all
documents, weighted by tf-idf and scaled to equal length, have their right singular vectors found by a randomised
decomposition in one pass (Nystroem: each task adds up its part of A'(A W) for a random W, the parts are added in a tree, and the
driver decomposes the sum). A word counts once in a block of eight. Passages of few distinct words say little and stay out of the sum, not out
of the search. Every passage of every document and windows of every benchmark item are projected on the
``RANK`` leading directions and compared by cosine, item windows as the stated query set in blocks; and again with all words weighing the same, on
directions scaled to equal variance, since rare words decide the first cosine. Only passages above ``least_cosine`` are
candidates: nothing else reaches a confirmation. The words around them are compared on the spot: the longest common subsequence of the
item's words and a piece of one and a half times their number must cover ``strong`` of the item, or ``weak`` of it and also the item's
answer, its last five words. Subsequences are taken for many pieces in step, by bit operations. Since this is done on 16 bits of a word, which can
only find too much, the documents left are read again and confirmed on 64 bits of each word.

Items of fewer than ``SHORT`` words say too little for a likeness: they are found where all their words stand in a row, by
64-bit hashes, with cosine, lcs and answer 1.

Defined results: null and empty texts on either side match nothing; repeated documents give repeated rows; of several
passages that match an item in one document the best is reported; an empty table on either side gives an empty result. Extra
columns are left out. A long document is searched in overlapping parts, so that memory doesn't grow with it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from constella.llm import common

#: Hashed terms of the decomposition, directions kept, directions sketched, words of a block.
TERMS, RANK, SKETCHED, STEP = 1 << 15, 48, 56, 8
#: Words that are searched in one go, and words of all items of one query block (one pass over the documents serves each).
CHUNK_WORDS, ITEM_WORDS = 1 << 15, 1 << 16
#: Inverse document frequency (natural logarithm) from which a term gets weight, what common terms keep of it, distinct words
#: of a passage that the decomposition needs.
LEAST_IDF, COMMON_WEIGHT, LEAST_DISTINCT = 2.5, 0.02, 20
#: Cosine from which a passage is a candidate; so much more is asked of it in the space of unweighted words.
LEAST_COSINE, FLAT_MORE = 0.5, 0.15
#: Occurrences of a term in a chunk beyond which they are added up by a matrix.
OFTEN = 8
#: Cells of the tables of a group of items, pieces that are confirmed in one go, cosines (so few that they stay in the cache) and words of pieces
#: that are held at once, blocks whose sums stay in the cache.
CELLS, BLOCK_SLICE, COSINES, HELD, SLICE_ROWS = 1 << 20, 1 << 10, 1 << 19, 1 << 20, 1 << 9
#: Words at the end of an item that count as its answer; words below which an item has to stand as a whole; short items of one pass.
ANSWER, SHORT, SHORT_ITEMS = 5, 8, 1 << 20


def _words(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and 64-bit hashes of the words of each text."""
    for first, _, data, offsets in common.text_chunks(column):
        words, before = common.word_hashes(data, offsets, common.NOT_ALNUM)
        for i, (a, b) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
            yield first + i, words[a:b]


def _small(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(48)).astype(np.uint16)


def hashed_terms(source: DataFrame) -> DataFrame:
    """Hashed words of each document, and one more row for each task with its document frequencies."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, schema, n = np.zeros(TERMS + 1, np.int64), None, 0
        for batch in common.sliced(batches):
            rows = []
            for _, w in _words(batch.column("text")):
                t = _small(w)
                rows.append(t.tobytes())
                ordered = np.sort(t >> 1, kind="stable")
                counts[ordered[np.flatnonzero(np.diff(ordered, prepend=TERMS))]] += 1
                n += 1
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.binary()), pa.nulls(len(rows), pa.binary())], names=["doc_id", "terms", "df"])
            schema = out.schema
            yield out
        if schema is not None:
            counts[TERMS] = n
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, counts.tobytes()), schema, strict=True)], schema=schema)

    return source.mapInArrow(run, f"doc_id {kind}, terms binary, df binary")


def _once(blocks: np.ndarray) -> np.ndarray:
    """Blocks of terms with every repetition inside a block replaced by the term of weight 0."""
    order = np.argsort(blocks, axis=1, kind="stable")
    ordered = np.take_along_axis(blocks, order, axis=1)
    again = np.zeros(blocks.shape, bool)
    again[:, 1:] = ordered[:, 1:] == ordered[:, :-1]
    ordered[again] = TERMS
    out = np.empty_like(blocks)
    np.put_along_axis(out, order, ordered, axis=1)
    return out


def term_weights(counts: np.ndarray) -> np.ndarray:
    """Weight of each hashed term from its document frequency; the last entry of ``counts`` is the number of documents."""
    idf = np.log((counts[TERMS] + 1) / (counts[:TERMS] + 1))
    return np.maximum(idf - LEAST_IDF, 0) + COMMON_WEIGHT


class Blocks:
    """Documents of a chunk cut into blocks of eight words; the last block of each is filled with a term of weight 0."""

    def __init__(self, docs: list[np.ndarray]):
        self.docs = docs
        self.each = np.array([-(-len(d) // STEP) for d in docs], np.int64)
        self.first = np.cumsum(self.each) - self.each
        self.terms = np.full(int(self.each.sum()) * STEP, TERMS, np.int64)
        for d, at in zip(docs, (self.first * STEP).tolist(), strict=True):
            self.terms[at : at + len(d)] = d >> 1
        self.words = self.terms
        self.terms = _once(self.terms.reshape(-1, STEP)).ravel()
        self.doc = np.repeat(np.arange(len(docs)), self.each)
        self.nth = np.arange(len(self.doc)) - np.repeat(self.first, self.each)

    def project(self, table: np.ndarray) -> np.ndarray:
        """Sum of the table's rows over each block."""
        terms = self.terms.reshape(-1, STEP)
        out = np.empty((len(terms), table.shape[1]), table.dtype)
        held = np.empty((SLICE_ROWS, table.shape[1]), table.dtype)
        # A slice of the sums stays in the cache while the rows of its eight words are added.
        for low in range(0, len(terms), SLICE_ROWS):
            some, sums = terms[low : low + SLICE_ROWS], out[low : low + SLICE_ROWS]
            np.take(table, some[:, 0], axis=0, out=sums, mode="clip")
            for i in range(1, STEP):
                sums += np.take(table, some[:, i], axis=0, out=held[: len(some)], mode="clip")
        return out

    def passages(self, blocks: np.ndarray, n: int) -> np.ndarray:
        """From each block on the sum of ``n`` blocks, as far as the document goes."""
        out = blocks.copy()
        left = self.each[self.doc] - self.nth
        for i in range(1, n):
            inside = np.flatnonzero(left > i)
            out[inside] += blocks[inside + i]
        return out


def _chunks(batches: Iterator[pa.RecordBatch], overlap: int = 0) -> Iterator[tuple[list, list[np.ndarray], bool]]:
    """Ids and words of documents, ``CHUNK_WORDS`` or so at a time. A longer document comes in parts that share ``overlap`` words, each by
    itself; the flag says that more of it follows."""
    ids, docs, size = [], [], 0
    step = max(CHUNK_WORDS, overlap) // STEP * STEP
    for batch in common.sliced(batches):
        for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("terms"), strict=True):
            d = np.frombuffer(t.as_buffer(), np.uint16)
            if not len(d):
                continue
            if size + len(d) > CHUNK_WORDS and docs:
                yield ids, docs, False
                ids, docs, size = [], [], 0
            at = 0
            while len(d) - at > step + overlap:
                yield [i], [d[at : at + step + overlap]], True
                at += step
            if at:
                yield [i], [d[at:]], False
            else:
                ids.append(i)
                docs.append(d)
                size += len(d)
    if docs:
        yield ids, docs, False


def _head_sums(rows: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``heads``, each of four at most."""
    lengths = np.diff(heads, append=len(rows))
    out = rows[heads]
    for i in range(1, int(lengths.max(initial=0))):
        longer = np.flatnonzero(lengths > i)
        out[longer] += rows[heads[longer] + i]
    return out


def _add_by_term(out: np.ndarray, terms: np.ndarray, passage: np.ndarray, sums: np.ndarray) -> None:
    """Adds to each term's row of ``out`` the sums of the passages where it occurs. Frequent terms are few: a matrix of their occurrences; the others
    are mostly single, so it goes occurrence by occurrence of all of them in step, those with more occurrences first."""
    order = np.argsort(terms.astype(np.uint16), kind="stable")
    ordered, passage = terms[order], passage[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    lengths = np.diff(starts, append=len(order))
    often = lengths > OFTEN
    if often.any():
        inside = np.repeat(often, lengths)
        cell = np.repeat(np.cumsum(often)[often] - 1, lengths[often]) * len(sums) + passage[inside]
        counts = np.bincount(cell, minlength=int(often.sum()) * len(sums)).astype(np.float32).reshape(-1, len(sums))
        out[ordered[starts[often]]] += counts @ sums
    seldom = np.flatnonzero(~often)
    if len(seldom):
        seldom = seldom[np.argsort(-lengths[seldom], kind="stable")]
        first, longer = starts[seldom], lengths[seldom]
        held = sums[passage[first]]
        for i in range(1, int(longer[0])):
            n = int(np.searchsorted(-longer, -i))
            held[:n] += sums[passage[first[:n] + i]]
        out[ordered[first]] += held


def latent_space(terms: DataFrame, weight: np.ndarray, seed: int = 11, even: bool = False) -> np.ndarray:
    """Table (one row for each hashed term, and a zero row) that projects weighted passages on leading singular directions; ``even``: on those after
    the first, which is their mean, each scaled to the same variance."""
    spark = terms.sparkSession
    random = np.random.default_rng(seed).standard_normal((TERMS, SKETCHED), dtype=np.float32)
    weighted = np.zeros((TERMS + 1, SKETCHED), np.float32)
    weighted[:-1] = random * weight[:, None]
    squares = np.append(weight, 0) ** 2
    telling = np.append(weight > min(2 * COMMON_WEIGHT, float(weight.max()) / 2), False)
    held = spark.sparkContext.broadcast((weighted, squares, telling))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, square, counted = held.value
        out = np.zeros((TERMS + 1, SKETCHED), np.float32)
        for _, docs, _ in _chunks(batches):
            blocks = Blocks(docs)
            heads = np.flatnonzero(blocks.nth % 4 == 0)
            group = np.cumsum(blocks.nth % 4 == 0) - 1
            each = blocks.terms.reshape(-1, STEP)
            length = np.add.reduceat(square[each].sum(axis=1), heads)
            distinct = np.add.reduceat((each < TERMS).sum(axis=1), heads)
            kept = np.flatnonzero(distinct >= LEAST_DISTINCT)
            at = np.flatnonzero(counted[blocks.terms] & np.repeat((distinct >= LEAST_DISTINCT)[group], STEP))
            if len(at):
                number = np.cumsum(distinct >= LEAST_DISTINCT) - 1
                sums = _head_sums(blocks.project(table), heads)[kept] / np.maximum(length[kept], 1e-12).astype(np.float32)[:, None]
                _add_by_term(out, blocks.terms[at], number[group[at // STEP]], sums)
        yield pa.RecordBatch.from_arrays([pa.array([out[:-1].tobytes()], pa.binary())], names=["part"])

    found = common.summed(terms.select("doc_id", "terms").mapInArrow(run, "part binary"), "part", TERMS * SKETCHED, "float32").reshape(TERMS, SKETCHED)
    held.destroy()
    del weighted
    found *= weight[:, None]
    out = np.zeros((TERMS + 1, RANK), np.float32)
    if not np.abs(found).max():
        # No passage is long enough to be decomposed: random directions keep cosines about right.
        out[:-1] = random[:, :RANK] * weight[:, None]
        return out
    found += np.float32(1e-6 * np.linalg.norm(found)) * random
    middle = random.T.astype(np.float64) @ found
    root = np.linalg.cholesky((middle + middle.T) / 2)
    # Left singular vectors from the small matrix of inner products, so that the driver holds few arrays of the vocabulary's size.
    found = np.linalg.solve(root, found.T).T
    values, turn = np.linalg.eigh(found.T @ found)
    kept = np.argsort(-values)[int(even) : RANK + int(even)]
    # ``values`` are those of the sum A'A, the squares of singular values.
    scale = values[kept] if even else np.sqrt(np.maximum(values[kept], 1e-30))
    out[:-1, : len(kept)] = (found @ (turn[:, kept] / np.maximum(scale, 1e-30))) * weight[:, None]
    return out


def latent_spaces(terms: DataFrame, counts: np.ndarray) -> np.ndarray:
    """Both projections side by side, each fitted on all documents: by tf-idf, and by unweighted words. Rare words decide the first, so an item whose
    rare words were replaced is found in the second."""
    return np.hstack([latent_space(terms, term_weights(counts)), latent_space(terms, np.ones(TERMS), even=True)])


# --- confirmation ------------------------------------------------------------------------------


class Items:
    """Items of one length class: tables from the words that occur in any of them to places in each item.

    ``masks[w, k]`` has a bit for each place of word w in item k.
    """

    def __init__(self, items: list[np.ndarray], at: np.ndarray, strong: float, weak: float):
        self.at = at
        self.n = np.array([len(t) for t in items], np.int64)
        self.span = self.n + self.n // 2
        self.limbs = -(-int(self.n.max()) // 64)
        known = np.unique(np.concatenate(items))
        self.row = np.full((1 << 16) + 1, len(known), np.int32)
        self.row[known] = np.arange(len(known))
        self.none = len(known)
        self.masks = np.zeros((len(known) + 1, len(items), self.limbs), np.uint64)
        for k, t in enumerate(items):
            rows = self.row[t]
            for i, r in enumerate(rows.tolist()):
                self.masks[r, k, i >> 6] |= np.uint64(1 << (i & 63))
        self.has = self.masks.any(axis=2)
        self.strong, self.weak = _least(strong, self.n), _least(weak, self.n)
        self.answers = np.minimum(ANSWER, self.n)
        self.told = _least(0.8, self.answers)

    def confirmed(self, words: np.ndarray, told: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (words >= self.strong[k]) | (words >= self.weak[k]) & (told >= self.told[k])

    def subsequences(self, words: np.ndarray, k: np.ndarray, answer: bool = False) -> np.ndarray:
        """Longest common subsequence of each row of words with its item, or with the item's answer (Hyyro 2004, many rows in step)."""
        top = self.n[k] - (self.answers[k] if answer else 0)
        limb = np.arange(self.limbs)
        places = lambda upto: np.where(upto[:, None] >= 64 * (limb + 1), ~np.uint64(0), (np.uint64(1) << np.clip(upto[:, None] - 64 * limb, 0, 63).astype(np.uint64)) - np.uint64(1))
        inside = places(self.n[k])
        if answer:
            inside &= ~places(top)
        row = np.full((len(k), self.limbs), ~np.uint64(0))
        for j in range(words.shape[1]):
            both = row & self.masks[words[:, j], k] & inside
            rest = row - both
            if self.limbs == 1:
                row = (row + both) | rest
                continue
            carry = np.zeros(len(k), np.uint64)
            for x in range(self.limbs):
                total = row[:, x] + both[:, x]
                over = total < both[:, x]
                total += carry
                carry = (over | (total < carry)).astype(np.uint64)
                row[:, x] = total | rest[:, x]
        return np.bitwise_count(~row & inside).sum(axis=1).astype(np.int64)

    def finely(self, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same pieces and, for items of less than two blocks, which may begin late in a block, those from each word of the block on."""
        fine = np.flatnonzero(self.n[k] < 2 * STEP)
        if not len(fine):
            return start, end, k
        start = np.concatenate([start, *[start[fine] + i for i in range(1, STEP)]])
        return start, np.concatenate([end, np.tile(end[fine], STEP - 1)]), np.concatenate([k, np.tile(k[fine], STEP - 1)])

    def confirm(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of pieces of the words ``rows`` (from ``start``, inside a document that ends at ``end``) those that hold their item: numbers of
        the pieces, words of the item and words of its answer that they have in order."""
        # No subsequence is longer than the number of the piece's words that the item has at all.
        least = np.minimum(self.weak, self.strong)
        some = np.flatnonzero(self.held(rows, start, end, k) >= least[k])
        for low in range(0, len(some), BLOCK_SLICE):
            which = some[low : low + BLOCK_SLICE]
            at, item = start[which], k[which]
            places = at[:, None] + np.arange(int(self.span[item].max()))
            words = np.where(places < np.minimum(at + self.span[item], end[which])[:, None], rows[np.minimum(places, len(rows) - 1)], self.none)
            found = self.subsequences(words, item)
            likely = np.flatnonzero(found >= least[item])
            if len(likely):
                told = self.subsequences(words[likely], item[likely], answer=True)
                good = self.confirmed(found[likely], told, item[likely])
                yield which[likely[good]], found[likely[good]], told[good]

    def held(self, rows: np.ndarray, start: np.ndarray, end: np.ndarray, k: np.ndarray) -> np.ndarray:
        """How many words of each piece its item has. Pieces of an item that overlap share one running count of their words."""
        stop = np.maximum(np.minimum(start + self.span[k], end), start)
        order = np.lexsort((start, k))
        item, low, high = k[order], start[order], stop[order]
        out = np.zeros(len(k), np.int64)
        if not len(k):
            return out
        # Ends rise with the starts inside an item, so a stretch ends where a piece begins beyond the one before.
        fresh = np.ones(len(k), bool)
        fresh[1:] = (item[1:] != item[:-1]) | (low[1:] > high[:-1])
        heads = np.flatnonzero(fresh)
        size = high[np.append(heads[1:], len(k)) - 1] - low[heads]
        first = np.cumsum(size) - size
        stretch = np.cumsum(fresh) - 1
        for a, b in _slices(size):
            words = np.repeat(low[heads[a:b]] - first[a:b], size[a:b]) + np.arange(first[a], first[a] + int(size[a:b].sum()))
            count = np.append(0, np.cumsum(self.has[rows[words], np.repeat(item[heads[a:b]], size[a:b])]))
            mine = slice(heads[a], heads[b] if b < len(heads) else len(k))
            at = low[mine] - low[heads[stretch[mine]]] + first[stretch[mine]] - first[a]
            out[order[mine]] = count[at + high[mine] - low[mine]] - count[at]
        return out


def _slices(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose sizes add up to ``HELD`` or so."""
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // HELD, prepend=0)) + 1
    edges = np.unique(np.concatenate([[0], cuts, [len(size)]])).tolist()
    yield from zip(edges[:-1], edges[1:], strict=True)


def _columns(vectors: np.ndarray) -> np.ndarray:
    """Vectors as columns, filled up with zeros to a multiple of eight of them."""
    return np.ascontiguousarray(np.pad(vectors, ((0, -len(vectors) % 8), (0, 0))).T)


def _places(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, few of a table whose width is a multiple of eight: eight cells are looked at together."""
    cells = table.ravel()
    some = np.flatnonzero(cells.view(np.uint64))
    inside = np.flatnonzero(cells.reshape(-1, 8)[some].ravel())
    return np.divmod(some[inside >> 3] * 8 + (inside & 7), table.shape[1])


def _distinct(numbers: np.ndarray) -> np.ndarray:
    """The same numbers, each once, in order."""
    ordered = np.sort(numbers)
    return ordered[np.flatnonzero(np.diff(ordered, prepend=ordered[:1] - 1))]


def _least(share: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(share * n - 1e-9).astype(np.int64)


def item_groups(items: list[np.ndarray], strong: float, weak: float) -> list[Items]:
    """Items in groups of similar length whose tables have ``CELLS`` cells at most, or one item."""
    out, group, order = [], [], sorted(range(len(items)), key=lambda k: len(items[k]))
    words = 0
    for k in order:
        n = len(items[k])
        if group and (words + n) * (len(group) + 1) * -(-n // 64) > CELLS:
            out.append(group)
            group, words = [], 0
        group.append(k)
        words += n
    return [Items([items[k] for k in g], np.array(g), strong, weak) for g in ([*out, group] if group else [])]


def item_windows(items: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Query windows of 32 words (16 for items of fewer than 32), every four words; their items, numbers of blocks and first words."""
    out, owner, n_blocks, first = [], [], [], []
    for k, t in enumerate(items):
        size = 32 if len(t) >= 32 else 16
        for at in sorted({*range(0, max(1, len(t) - size + 1), 4), max(0, len(t) - size)}):
            out.append(t[at : at + size])
            owner.append(k)
            n_blocks.append(size // STEP)
            first.append(at)
    return out, np.array(owner, np.int64), np.array(n_blocks, np.int64), np.array(first, np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


class Search:
    """One block of items and how they are looked for in a chunk of documents."""

    def __init__(self, table: np.ndarray, items: list[tuple[int, np.ndarray]], least_cosine: float, strong: float, weak: float):
        self.table, self.items, self.least_cosine = table, items, least_cosine
        self.groups = item_groups([t for _, t in items], strong, weak)
        self.group_of = np.zeros(len(items), np.int64)
        self.inside = np.zeros(len(items), np.int64)
        for g, group in enumerate(self.groups):
            self.group_of[group.at], self.inside[group.at] = g, np.arange(len(group.at))
        windows, self.owner, self.n_blocks, self.first = item_windows([t for _, t in items])
        blocks = Blocks(windows)
        windows = blocks.passages(blocks.project(table), 4)[blocks.first]
        self.vectors, self.flat = _unit(windows[:, :RANK]).astype(np.float32), _unit(windows[:, RANK:]).astype(np.float32)
        self.longest = max((len(t) for _, t in items), default=0)

    def near(self, blocks: Blocks, passages: dict[int, np.ndarray]) -> np.ndarray:
        """Rows (first block of the passage, item, first word of the item's window) of all passages above the least cosine."""
        out = [np.zeros((0, 3), np.int64)]
        for n, sums in passages.items():
            chosen = np.flatnonzero(self.n_blocks == n)
            at = np.arange(len(blocks.doc)) if n == 2 else np.flatnonzero(blocks.nth % 2 == 0)
            weighted, even = _columns(self.vectors[chosen]), _columns(self.flat[chosen])
            height = max(1, COSINES // weighted.shape[1])
            for low in range(0, len(at), height):
                some = at[low : low + height]
                close = _unit(sums[some, :RANK]) @ weighted >= self.least_cosine
                close |= _unit(sums[some, RANK:]) @ even >= self.least_cosine + FLAT_MORE
                p, q = _places(close)
                p, q = p[q < len(chosen)], q[q < len(chosen)]
                out.append(np.stack([some[p], self.owner[chosen[q]], self.first[chosen[q]]], axis=1))
        return np.concatenate(out)

    def pieces(self, near: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
        """Blocks and items of the pieces around those passages that may hold the item, each once."""
        if not len(near):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        length = np.array([len(t) for _, t in self.items])[near[:, 1]]
        # Where the item would begin if the passage is its window, and earlier by half of the words that a piece has more than the item.
        begin = near[:, 0] - -(-near[:, 2] // STEP)
        low = np.maximum(blocks.first[blocks.doc[near[:, 0]]], begin - -(-length // (4 * STEP)) - 1)
        high = np.minimum((blocks.first + blocks.each)[blocks.doc[near[:, 0]]], begin + 3)
        high = np.maximum(high, low)
        size = high - low
        at = np.repeat(low, size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        both = _distinct(at * len(self.items) + np.repeat(near[:, 1], size))
        return both // len(self.items), both % len(self.items)

    def __call__(self, docs: list[np.ndarray]) -> dict[tuple[int, int], tuple[float, float, float]]:
        """(share of the item, cosine, share of its answer) of the best piece, by document of the chunk and item."""
        blocks = Blocks(docs)
        projected = blocks.project(self.table)
        passages = {n: blocks.passages(projected, n) for n in np.unique(self.n_blocks).tolist()}
        words = np.full(len(blocks.words), 1 << 16, np.int64)
        for d, first in zip(docs, (blocks.first * STEP).tolist(), strict=True):
            words[first : first + len(d)] = d
        at, item = self.pieces(self.near(blocks, passages), blocks)
        group = self.group_of[item]
        ends = blocks.first * STEP + np.array([len(d) for d in docs])
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for g, items in enumerate(self.groups):
            rows = items.row[words]
            mine = group == g
            # All pieces of the chunk are confirmed together, each once.
            start, k = np.divmod(_distinct(at[mine] * len(items.n) + self.inside[item[mine]]), len(items.n))
            start, end, k = items.finely(start * STEP, ends[blocks.doc[start]], k)
            for which, found, told in items.confirm(rows, start, end, k):
                for place, kk, f, t in zip(start[which].tolist(), k[which].tolist(), found.tolist(), told.tolist(), strict=True):
                    key = (int(blocks.doc[place // STEP]), int(items.at[kk]))
                    if (f, t, -place) > best.get(key, (0, 0, 0)):
                        best[key] = (f, t, -place)
        out = {}
        for (d, k), (f, t, place) in best.items():
            n = len(self.items[k][1])
            near = slice(*np.searchsorted(self.owner, [k, k + 1]))
            first = -place // STEP
            inside = slice(first, min(first + max(1, -(-(n + n // 2) // STEP)), int(blocks.first[d] + blocks.each[d])))
            cosine = float((_unit(passages[int(self.n_blocks[near][0])][inside, :RANK]) @ self.vectors[near].T).max())
            out[d, k] = (f / n, cosine, t / min(ANSWER, n))
        return out


def _results(doc: DataType, item: DataType) -> tuple[str, pa.Schema]:
    """Columns of a match, for Spark and for Arrow."""
    names = ("doc_id", "item_id", "cosine", "lcs", "answer")
    kinds = (doc.simpleString(), item.simpleString(), "double", "double", "double")
    types = (to_arrow_type(doc), to_arrow_type(item), pa.float64(), pa.float64(), pa.float64())
    return ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)), pa.schema(list(zip(names, types, strict=True)))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def search(terms: DataFrame, table: np.ndarray, items: list[np.ndarray], least_cosine: float, strong: float, weak: float) -> DataFrame:
    """doc_id, item (its number) and cosine of every candidate that 16 bits of each word confirm."""
    held = terms.sparkSession.sparkContext.broadcast((table, list(enumerate(items))))
    kind = terms.schema["doc_id"].dataType
    schema = pa.schema([("doc_id", to_arrow_type(kind)), ("item", pa.int32()), ("cosine", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Search(*held.value, least_cosine, strong, weak)
        earlier: dict[int, float] = {}
        for ids, docs, more in _chunks(batches, 4 * look.longest):
            best = {key: cosine for key, (_, cosine, _) in look(docs).items()}
            # The parts of a long document come one after the other.
            for k, cosine in earlier.items():
                best[0, k] = max(best.get((0, k), cosine), cosine)
            earlier = {k: cosine for (_, k), cosine in best.items()} if more else {}
            if best and not more:
                yield _batch([(ids[d], k, round(cosine, 4)) for (d, k), cosine in best.items()], schema)

    return terms.select("doc_id", "terms").mapInArrow(run, f"doc_id {kind.simpleString()}, item int, cosine double")


def exact_share(item: np.ndarray, words: np.ndarray, strong: float, weak: float) -> tuple[float, float] | None:
    """Shares of the item and of its answer that the best piece of a document's words has in order, if that confirms it; both as 64-bit words."""
    known, ranks = np.unique(item, return_inverse=True)
    place = np.minimum(np.searchsorted(known, words), len(known) - 1)
    words = np.where(known[place] == words, place, 1 << 16)
    one = Items([ranks.astype(np.int64)], np.zeros(1, np.int64), strong, weak)
    start = np.arange(0, len(words), STEP)
    start, end, k = one.finely(start, np.full(len(start), len(words)), np.zeros(len(start), np.int64))
    best = None
    for which, found, told in one.confirm(one.row[words], start, end, k):
        for place, f, t in zip(start[which].tolist(), found.tolist(), told.tolist(), strict=True):
            best = max(best or (0, 0, 0), (f, t, -place))
    return best and (best[0] / len(item), best[1] / min(ANSWER, len(item)))


def confirmed_matches(source: DataFrame, found: DataFrame, items: list[tuple[object, np.ndarray]], item_type: DataType, strong: float, weak: float) -> DataFrame:
    """The candidates that hold on 64-bit words, by reading their documents again."""
    held = source.sparkSession.sparkContext.broadcast(items)
    columns, schema = _results(source.schema["doc_id"].dataType, item_type)
    asked = found.groupBy("doc_id", "item").agg(F.max("cosine").alias("cosine")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list(F.struct("item", "cosine")).alias("asked"))
    # Written, so that few candidates are known to be few: texts travel only where there are too many.
    asked = common.cut(asked, "leaks-asked")
    few = asked.agg(F.sum(F.size("asked")).alias("n")).first()["n"] or 0
    asked = F.broadcast(asked) if few <= common.BROADCAST_IDS else asked
    again = source.join(asked, F.col("doc_id").eqNullSafe(F.col("_id"))).select("doc_id", "text", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows, ids, asked = [], batch.column("doc_id"), batch.column("asked")
            for i, w in _words(batch.column("text")):
                for one in asked[i].as_py():
                    item_id, item = held.value[one["item"]]
                    if share := exact_share(item, w, strong, weak):
                        rows.append((ids[i].as_py(), item_id, one["cosine"], round(share[0], 4), round(share[1], 4)))
            yield _batch(rows, schema)

    return again.mapInArrow(run, columns)


def short_matches(source: DataFrame, items: list[tuple[object, np.ndarray]], item_type: DataType) -> DataFrame:
    """The same columns for short items (their 64-bit words): documents in which all of their words stand in a row."""
    by_size: dict[int, dict[int, list]] = {}
    for k, w in items:
        by_size.setdefault(len(w), {}).setdefault(int(common.fold(w, len(w))[0]), []).append(k)
    held = source.sparkSession.sparkContext.broadcast({n: (np.array(sorted(x), np.uint64), x) for n, x in by_size.items()})
    columns, schema = _results(source.schema["doc_id"].dataType, item_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            rows, ids = [], batch.column("doc_id")
            for i, w in _words(batch.column("text")):
                for n, (folded, owners) in held.value.items():
                    if len(w) >= n:
                        here = common.fold(w, n)
                        place = np.minimum(np.searchsorted(folded, here), len(folded) - 1)
                        rows += [(ids[i].as_py(), k, 1.0, 1.0, 1.0) for x in set(here[folded[place] == here].tolist()) for k in owners[x]]
            yield _batch(rows, schema)

    return source.mapInArrow(run, columns)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    least_cosine: float = LEAST_COSINE, strong: float = 0.7, weak: float = 0.5,
) -> DataFrame:
    """One row for each document and benchmark item that it holds: doc_id, item_id, cosine, lcs, answer."""
    source = common.pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    queries = common.pick(benchmark, item_id=item_col, text=item_text_col).where("text is not null").orderBy("item_id", "text")
    written = common.cut(hashed_terms(source), "terms")
    counts = common.summed(written.where("df is not null"), "df", TERMS + 1)
    terms = written.where("df is null")
    table = latent_spaces(terms, counts)
    item_type = queries.schema["item_id"].dataType
    found = terms.sparkSession.createDataFrame([], _results(terms.schema["doc_id"].dataType, item_type)[0])
    for block, short in _item_blocks(queries):
        if block:
            near = search(terms, table, [_small(w) for _, w in block], least_cosine, strong, weak)
            found = found.unionByName(confirmed_matches(source, near, block, item_type, strong, weak))
        if short:
            found = found.unionByName(short_matches(source, short, item_type))
    # Written, so that the hashed documents can go.
    out = common.cut(found, "leaks-found")
    common.drop(written)
    return out


def _item_blocks(queries: DataFrame) -> Iterator[tuple[list, list]]:
    """Items with their 64-bit words, ``ITEM_WORDS`` words or so at a time, and short items."""
    block, short, size = [], [], 0
    for row in queries.toLocalIterator():
        for _, w in _words(pa.array([row["text"]])):
            if 0 < len(w) < SHORT:
                short.append((row["item_id"], w.copy()))
            elif len(w):
                block.append((row["item_id"], w.copy()))
                size += len(w)
        if size >= ITEM_WORDS or len(short) == SHORT_ITEMS:
            yield block, short
            block, short, size = [], [], 0
    if block or short:
        yield block, short


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
