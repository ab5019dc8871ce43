"""Quality classifier: a generalised additive model with pairwise interactions over text statistics.

Cyclic boosting: in turn each feature gets a shallow tree fitted to the current logistic gradients over its
bins, shrunk and added to that feature's lookup table; then the pairs of features whose two-way tables reduce the loss most get
tables of their own in the same way, by trees that cut a coarse grid of both into a few rectangles. A text's score is the sum of its bins' entries through the logistic
function, computed for a whole batch by indexing.

Defined results: null and empty texts are scored like any other, from features that are all zero; a null label
is not learned from; where no labelled row can be learned from, every score is 0.5. Repeated rows score equally. An empty
table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: Labelled rows that are learned from, about, at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20000

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "letters", "upper", "digits", "spaces", "line_ends", "full_stops", "commas", "bars", "other_marks",
    "beyond_ascii", "repeated_words", "top_word", "same_as_last", "pair_top", "words_per_line", "repeated_lines", "upper_words", "marked_words", "long_words",
)

_CLASS = np.full(256, 8, np.uint8)
for _i, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\x0c", b"\n", b".", b",", b"|")):
    _CLASS[list(_chars)] = _i
_CLASS[128:] = 9


def text_features(column: pa.Array) -> np.ndarray:
    """One row of numbers for each text, over the whole text; all zero for null and empty texts."""
    out = np.zeros((len(column), len(FEATURES)))
    for first, end, data, offsets in common.text_chunks(column):
        kinds = _CLASS[data]
        _, start, stop, before = common.word_spans(data, offsets)
        words, _ = common.word_hashes(data, offsets)
        marked = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds == 8, out=marked[1:])
        capital = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kinds == 1, out=capital[1:])
        length = stop - start
        n_marked, n_upper = marked[stop] - marked[start], capital[stop] - capital[start]
        for row in range(first, end):
            a, b = int(offsets[row - first]), int(offsets[row - first + 1])
            i, j = int(before[row - first]), int(before[row - first + 1])
            if b == a:
                continue
            size, n = b - a, j - i
            c = np.bincount(kinds[a:b], minlength=10) / size
            x = out[row]
            x[0], x[1] = np.log1p(size), np.log1p(n)
            x[3:5] = c[:2]
            x[5:12] = c[2], c[3], c[4], c[5], c[6], c[7], c[8]
            x[12] = c[9]
            lines = c[4] * size + 1
            x[17] = np.log1p(n / lines)
            if n:
                w = words[i:j]
                _, counts = np.unique(w, return_counts=True)
                x[2] = size / n
                x[13] = 1 - len(counts) / n
                x[14] = counts.max() / n
                x[15] = np.count_nonzero(w[1:] == w[:-1]) / n
                if n > 1:
                    _, counts = np.unique(w[1:] * np.uint64(3) + w[:-1], return_counts=True)
                    x[16] = counts.max() / n
                x[19] = np.count_nonzero(n_upper[i:j] > 1) / n
                x[20] = np.count_nonzero(n_marked[i:j]) / n
                x[21] = np.count_nonzero(length[i:j] > 15) / n
            if lines > 2:
                ends = np.flatnonzero(kinds[a:b] == 4)
                text = data[a:b].tobytes()
                at, seen, twice = 0, set(), 0
                for e in [*ends.tolist(), size]:
                    line = text[at:e]
                    twice += len(line) if line in seen else 0
                    seen.add(line)
                    at = e + 1
                x[18] = twice / size
    return out


# --- the model ---------------------------------------------------------------------------------


@dataclass
class Gam:
    """Bin edges, a lookup table for each feature and for each chosen pair, and the intercept."""

    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    base: float = 0.0

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1) if self.edges else np.zeros((len(x), 0), int)

    def margin(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for k, t in enumerate(self.tables):
            out += t[bins[:, k]]
        for i, j, t in self.pairs:
            out += t[bins[:, i], bins[:, j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values for ordered bins by greedy splits into at most ``leaves`` runs (a shallow tree on one feature)."""
    g, h = np.concatenate([[0], np.cumsum(gradient)]), np.concatenate([[0], np.cumsum(weight)])
    gain = lambda i, j: (g[j] - g[i]) ** 2 / (h[j] - h[i] + ridge)
    runs = [(0, len(gradient))]
    while len(runs) < leaves:
        best = (1e-9, None, None)
        for i, j in runs:
            if j - i > 1:
                cut = np.arange(i + 1, j)
                better = gain(i, cut) + gain(cut, j) - gain(i, j)
                k = int(np.argmax(better))
                if better[k] > best[0]:
                    best = (better[k], (i, j), int(cut[k]))
        if best[1] is None:
            break
        i, j = best[1]
        runs.remove((i, j))
        runs += [(i, best[2]), (best[2], j)]
    out = np.zeros(len(gradient))
    for i, j in runs:
        out[i:j] = (g[j] - g[i]) / (h[j] - h[i] + ridge)
    return out


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Values of a grid by greedy cuts along either side into at most ``leaves`` rectangles (a shallow tree on two features)."""
    gain = lambda g, h: g * g / (h + ridge)
    boxes = [(0, gradient.shape[0], 0, gradient.shape[1])]
    while len(boxes) < leaves:
        best = (1e-9, None, None)
        for a, b, c, d in boxes:
            g, h = gradient[a:b, c:d], weight[a:b, c:d]
            for axis, low in ((0, a), (1, c)):
                left_g, left_h = np.cumsum(g.sum(axis=1 - axis))[:-1], np.cumsum(h.sum(axis=1 - axis))[:-1]
                if not len(left_g):
                    continue
                better = gain(left_g, left_h) + gain(g.sum() - left_g, h.sum() - left_h) - gain(g.sum(), h.sum())
                k = int(np.argmax(better))
                if better[k] > best[0]:
                    at = low + k + 1
                    best = (better[k], (a, b, c, d), ((a, at, c, d), (at, b, c, d)) if axis == 0 else ((a, b, c, at), (a, b, at, d)))
        if best[1] is None:
            break
        boxes.remove(best[1])
        boxes += best[2]
    out = np.zeros(gradient.shape)
    for a, b, c, d in boxes:
        out[a:b, c:d] = gradient[a:b, c:d].sum() / (weight[a:b, c:d].sum() + ridge)
    return out


def fit_gam(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2, max_bins: int = 32, n_pairs: int = 6, pair_bins: int = 8) -> Gam:
    """Fit on features ``x`` and labels ``y`` in 0 and 1. Without both labels the model is constant."""
    model = Gam()
    if not len(y):
        return model
    share = np.clip(y.mean(), 0.5 / (len(y) + 1), 1 - 0.5 / (len(y) + 1))
    model.base = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return model
    model.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, max_bins + 1)[1:-1])) for k in range(x.shape[1])]
    bins = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    margin = model.margin(bins)
    ridge = 1.0

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for k, t in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[:, k], g, len(t)), np.bincount(bins[:, k], h, len(t)), 3, ridge)
            t += step
            margin += step[bins[:, k]]
    # Pairs are ranked by what a table over coarse bins takes from the loss that is left.
    g, h = slopes()
    coarse = [(np.arange(len(t)) * pair_bins // len(t)) for t in model.tables]
    gains = []
    for i in range(len(model.tables)):
        for j in range(i):
            cell = coarse[i][bins[:, i]] * pair_bins + coarse[j][bins[:, j]]
            a, b = np.bincount(cell, g, pair_bins**2), np.bincount(cell, h, pair_bins**2)
            gains.append((float((a * a / (b + ridge)).sum()), i, j))
    for _, i, j in sorted(gains, reverse=True)[:n_pairs]:
        model.pairs.append((i, j, np.zeros((len(model.tables[i]), len(model.tables[j])))))
    for _ in range(rounds // 4):
        for i, j, t in model.pairs:
            g, h = slopes()
            cell = coarse[i][bins[:, i]] * pair_bins + coarse[j][bins[:, j]]
            grids = [np.bincount(cell, x, pair_bins**2).reshape(pair_bins, pair_bins) for x in (g, h)]
            step = rate * _pair_tree(*grids, 4, 5 * ridge)
            t += step[coarse[i][:, None], coarse[j][None, :]]
            margin += step.ravel()[cell]
    return model


# --- operators ---------------------------------------------------------------------------------


def learning_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, fold: int = 5) -> DataFrame:
    """At most about ``rows`` labelled texts outside the held-out fold, chosen by a hash of the id, with their label."""
    known = common.pick(labels, id=id_col, label=label_col).where("label is not null and id is not null")
    known = known.where(common.crc_mod(F.col("id"), fold) != 0)
    total = known.count()
    if total > rows:
        known = known.where(common.uniform(F.col("id"), "quality") < rows / total)
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    texts = common.pick(docs, id=id_col, text=text_col)
    # About ``rows`` ids by the sampling above, each once: small enough for a broadcast.
    return texts.join(F.broadcast(known), "id").select("id", "text", F.col("label").cast("double").alias("label"))


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Gam:
    """Features are computed on the executors; the driver gets one row of numbers for each sampled text."""
    sample = learning_sample(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            x = pa.array(list(text_features(batch.column("text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), x, batch.column("label")], names=["id", "x", "label"])

    found = sample.mapInArrow(run, f"id {sample.schema['id'].dataType.simpleString()}, x array<double>, label double")
    # Of rows that share an id one is learned from, so the driver gets no more than the sample.
    rows = found.groupBy("id").agg(F.min(F.struct("x", "label")).alias("r")).select("r.x", "r.label").toPandas()
    if not len(rows):
        return Gam(base=0.0)
    x, y = np.stack(rows["x"].to_numpy()), rows["label"].to_numpy()
    order = np.lexsort((*x.T, y))
    return fit_gam(x[order], y[order])


def score_quality(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """doc_id, score in 0 to 1 (higher: label 1 is likelier) and predicted (1 from the threshold on)."""
    source = common.pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            score = np.round(model.score(text_features(batch.column("text"))), 6)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"]
            )

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def keep_good(docs: DataFrame, model: Gam, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with all their columns, in one pass and without a join."""
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            yield batch.filter(pa.array(np.round(model.score(text_features(batch.column(where))), 6) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col, fold: int = 5):
    return F.coalesce(common.crc_mod(id_col, fold) == 0, F.lit(False))


def op10_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    model = train_quality(docs, common.table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
