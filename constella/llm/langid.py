"""Language identification by a convolutional network over bytes, trained in numpy.

Each byte has a small learned vector; filters of several widths slide over fixed windows of bytes, each filter's
largest response over the window is kept, and a softmax over those maxima gives the languages. A text is cut into
consecutive windows that cover all of it (the last one padded with zeros); the log-probabilities of
its windows, weighted by their bytes, are summed and normalised.

Defined results: a text that is null or has no letter is ``und`` with score 0; null languages and ids are not learned from;
without anything to learn from every text is ``und``. Repeated rows get equal results. An empty table gives an empty
table. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: Bytes of a window, and windows that are convolved in one go.
WINDOW, BLOCK = 256, 256
#: The training sample: texts of each language, at most about; code points of the piece that is taken from each, anywhere in it.
SAMPLE_TEXTS, SAMPLE_CHARS = 1200, 2048
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a code point is a letter; digits of any script, fractions and circled numbers aren't."""
    return any(map(str.isalpha, text))


@dataclass
class Network:
    """Byte vectors, one filter bank for all widths (narrow ones are zero outside), output weights, languages."""

    vectors: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    mask: np.ndarray
    languages: list[str]

    def maxima(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each window of bytes, where it is, and the unfolded input."""
        width, size = self.filters.shape[0], self.vectors.shape[1]
        x = self.vectors[windows]
        n, length = windows.shape
        steps = length - width + 1
        view = np.lib.stride_tricks.as_strided(x, (n, steps, width * size), (x.strides[0], x.strides[1], x.strides[2]))
        unfolded = np.ascontiguousarray(view).reshape(n * steps, width * size)
        responses = (unfolded @ self.filters.reshape(width * size, -1)).reshape(n, steps, -1)
        return responses.max(axis=1), responses, unfolded

    def log_probabilities(self, windows: np.ndarray) -> np.ndarray:
        hidden = np.maximum(self.maxima(windows)[0] + self.bias, 0)
        z = hidden @ self.out + self.out_bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def windows_of(data: np.ndarray, length: int = WINDOW) -> np.ndarray:
    """Consecutive windows over all the bytes, at least one, the last padded with zeros."""
    n = max(1, -(-len(data) // length))
    out = np.zeros(n * length, np.uint8)
    out[: len(data)] = data
    return out.reshape(n, length)


def train_network(texts: list[bytes], labels: list[str], widths: tuple[int, ...] = (2, 3, 4), per_width: int = 8, size: int = 6, epochs: int = 6, seed: int = 7) -> Network:
    """Stochastic gradient descent (Adam) on windows of the texts; deterministic for a given order of texts."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    width = max(widths)
    mask = np.zeros((width, size, per_width * len(widths)), np.float32)
    for i, w in enumerate(widths):
        mask[:w, :, i * per_width : (i + 1) * per_width] = 1
    shape = (256, size)
    net = Network(
        rng.normal(0, 0.5, shape).astype(np.float32), (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(mask.shape[2], np.float32),
        rng.normal(0, 0.1, (mask.shape[2], len(languages))).astype(np.float32), np.zeros(len(languages), np.float32), mask, languages,
    )
    if len(languages) < 2:
        return net
    pieces = [windows_of(np.frombuffer(t, np.uint8)) for t in texts]
    x = np.concatenate(pieces)
    y = np.repeat([languages.index(v) for v in labels], [len(p) for p in pieces])
    # Windows of short texts teach the same languages from little text: each window is also cut at random.
    params = [net.vectors, net.filters, net.bias, net.out, net.out_bias]
    first, second, count = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = (len(y) / len(languages) / np.maximum(np.bincount(y, minlength=len(languages)), 1)).astype(np.float32)
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 64):
            pick = order[at : at + 64]
            batch, target = x[pick].copy(), y[pick]
            short = rng.random(len(pick)) < 0.3
            for i in np.flatnonzero(short):
                batch[i, rng.integers(16, WINDOW) :] = 0
            best, responses, _ = net.maxima(batch)
            place = responses.argmax(axis=1)
            hidden = np.maximum(best + net.bias, 0)
            z = hidden @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), target] -= 1
            p *= (weight[target] / len(pick))[:, None]
            d_hidden = (p @ net.out.T) * (hidden > 0)
            rows = np.arange(len(pick))[:, None]
            taps = batch[rows[:, :, None], place[:, :, None] + np.arange(width)]
            inputs = net.vectors[taps]
            d_filters = np.einsum("nf,nfwe->wef", d_hidden, inputs) * mask
            d_inputs = np.einsum("nf,wef->nfwe", d_hidden, net.filters)
            d_vectors = np.zeros_like(net.vectors)
            np.add.at(d_vectors, taps.ravel(), d_inputs.reshape(-1, size))
            count += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, (w, g) in enumerate(zip(params, (d_vectors, d_filters, d_hidden.sum(axis=0), hidden.T @ p, p.sum(axis=0)), strict=True)):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                w -= (rate * (first[k] / (1 - 0.9**count)) / (np.sqrt(second[k] / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
    return net


def classify(net: Network, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and probability of each whole text; windows of many texts go through the network together."""
    n = len(column)
    names, scores = [UNKNOWN] * n, [0.0] * n
    known = [i for i, t in enumerate(column.to_pylist()) if t and has_letter(t)] if net.languages else []
    wanted = np.zeros(n, bool)
    wanted[known] = True
    for first, end, data, offsets in common.text_chunks(column):
        rows = [r for r in range(first, end) if wanted[r]]
        if not rows:
            continue
        pieces = [windows_of(data[offsets[r - first] : offsets[r - first + 1]]) for r in rows]
        windows = np.concatenate(pieces)
        each = np.array([len(p) for p in pieces])
        logs = np.concatenate([net.log_probabilities(windows[i : i + BLOCK]) for i in range(0, len(windows), BLOCK)]).astype(np.float64)
        sizes = np.full(len(windows), float(WINDOW))
        ends = np.cumsum(each)
        totals = np.array([offsets[r - first + 1] - offsets[r - first] for r in rows])
        sizes[ends - 1] = totals - (each - 1) * WINDOW
        summed = np.add.reduceat(logs * (sizes / WINDOW)[:, None], ends - each, axis=0)
        summed -= summed.max(axis=1, keepdims=True)
        p = np.exp(summed)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        for r, k, row in zip(rows, best.tolist(), p, strict=True):
            names[r], scores[r] = net.languages[k], round(float(row[k]), 6)
    return names, scores


def train_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fold: int = 4, held: int = 2) -> Network:
    """Learn from rows outside the held-out fold: of each language about ``SAMPLE_TEXTS`` different texts, chosen by a hash of id and text."""
    rows = common.pick(docs, id=id_col, text=text_col, lang=lang_col).where("lang is not null and text is not null and id is not null")
    rows = rows.where(common.crc_mod(F.col("id"), fold) != held)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    chosen = rows.join(counts, "lang").where(common.uniform(F.xxhash64("id", "text"), "language") * F.col("n") < SAMPLE_TEXTS)
    start = F.floor(common.uniform(F.xxhash64("id", "text"), "piece") * (F.greatest(F.char_length("text") - SAMPLE_CHARS, F.lit(0)) + 1)).cast("int") + 1
    pieces = chosen.select("id", "lang", F.substring("text", start, F.lit(SAMPLE_CHARS)).alias("text")).distinct()
    got = sorted((r["id"], r["lang"], r["text"]) for r in pieces.collect())
    got = [(lang, text.encode()) for _, lang, text in got if has_letter(text)]
    return train_network([t for _, t in got], [lang for lang, _ in got])


def predict_languages(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    source = common.pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            names, scores = classify(net, pc.fill_null(batch.column("text"), ""))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    found = predict_languages(docs, train_languages(docs))
    return found.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
