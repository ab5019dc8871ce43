"""Periodic runs of words: repeated k-gram masking, then Main-Lorentz on the segments that survive.

A run is a maximal stretch of words with smallest period q and at least ``max(least, 2 q)`` words. Its words stand opposite each other, q apart,
along length - q >= k words with ``k = least / 2`` rounded up, so each of them lies in a k-gram that the document repeats. Words outside all repeated
k-grams can't join runs; k-grams are compared by hashes, whose collisions only let more words survive. Surviving stretches of all texts of
a batch are laid out with unique separators, their words numbered exactly. Main-Lorentz then asks, for every middle of the halving grid and every
period, how far the text around the middle agrees with itself a period away; all questions of one level are answered together from exact names of the
stretches of 1, 2, 4, ... words. Every run crosses exactly one middle of highest level within it; of periods reported for the same stretch
the smallest is kept.

Memory grows with the largest text: about 4 bytes a surviving word for each doubling of the longest segment.

Odd input: null, empty and white texts have no words and no runs; texts of any length are taken whole; rows that repeat stay rows; null ids stay; an
empty table gives an empty result; extra columns are ignored. Words are split at ASCII white space only, so other white space is part of a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: Words that a run has at least.
LEAST = 12
_SPACES = r"[\x20\x09-\x0D]+"
#: Questions (a middle and a period) that are answered in one go.
_QUESTIONS = 1 << 20


def repeated(grams: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Whether each gram occurs again in the same text."""
    key = common.mix(grams ^ common.mix(text.astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[order][1:] == key[order][:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[:-1] | same[1:]
    return out


def surviving(words: np.ndarray, before: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words that repeated k-grams cover, within texts, at least ``least`` words long."""
    k, n = -(-least // 2), len(words)
    none = np.zeros(0, np.int64)
    if n < least:
        return none, none
    text = np.repeat(np.arange(len(before) - 1), np.diff(before))
    inside = text[: n - k + 1] == text[k - 1 :]
    again = np.zeros(n - k + 1, bool)
    again[inside] = repeated(common.fold(words, k)[inside], text[: n - k + 1][inside])
    change = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(change, at, 1)
    np.add.at(change, at + k, -1)
    covered = np.cumsum(change[:-1]) > 0
    starts = np.flatnonzero(covered & np.concatenate([[True], ~covered[:-1] | (text[1:] != text[:-1])]))
    ends = np.flatnonzero(covered & np.concatenate([~covered[1:] | (text[1:] != text[:-1]), [True]])) + 1
    long = ends - starts >= least
    return starts[long], ends[long]


def _names(x: np.ndarray, longest: int) -> list[np.ndarray]:
    """Exact names of all stretches of 1, 2, 4, ... entries: equal names, equal stretches."""
    out = [x.astype(np.int32)]
    while (size := 1 << len(out)) <= longest:
        last = out[-1]
        if len(x) < size:
            break
        half = size // 2
        pair = last[: len(x) - size + 1].astype(np.int64) << 32 | last[half : half + len(x) - size + 1]
        out.append(np.unique(pair, return_inverse=True)[1].astype(np.int32))
    return out


def _ahead(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that starts at a and at b (a < b)."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        name = names[level]
        # A unique separator stands at the end, so no common stretch is twice as long as the longest one named.
        i, j = a + out, b + out
        ok = j < len(name)
        ok[ok] = name[i[ok]] == name[j[ok]]
        out[ok] += 1 << level
    return out


def _behind(names: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common stretch that ends at a and at b (a < b, both included)."""
    out = np.zeros(len(a), np.int64)
    for level in range(len(names) - 1, -1, -1):
        name, size = names[level], 1 << level
        i, j = a - out - size + 1, b - out - size + 1
        ok = i >= 0
        ok[ok] = name[i[ok]] == name[j[ok]]
        out[ok] += size
    return out


def main_lorentz(x: np.ndarray, start: np.ndarray, end: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and smallest period of all runs of ``x``, whose segments [start, end) are divided by unique entries."""
    names = _names(x, int((end - start).max(initial=0)))
    owner = np.full(len(x), -1)
    owner[np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), end.tolist(), strict=True)] or [np.zeros(0, int)])] = np.repeat(np.arange(len(start)), end - start)
    middles = np.arange(1, len(x))
    middles = middles[(owner[1:] >= 0) & (owner[1:] == owner[:-1])]
    reach = middles & -middles
    found = []
    for left in (True, False):
        room = np.minimum(reach, middles - start[owner[middles]] if left else end[owner[middles]] - middles)
        ends = np.cumsum(room)
        for first in range(0, int(ends[-1]) if len(ends) else 0, _QUESTIONS):
            asked = np.arange(first, min(first + _QUESTIONS, int(ends[-1])))
            which = np.searchsorted(ends, asked, side="right")
            m, p = middles[which], asked - (ends - room)[which] + 1
            a, b = (m - p, m) if left else (m, m + p)
            same = x[a] == x[b] if left else x[a - 1] == x[b - 1]
            a, b, p = a[same], b[same], p[same]
            ahead = np.where(b < len(x), _ahead(names, a, b), 0)
            behind = np.where(a > 0, _behind(names, a - 1, b - 1), 0)
            ok = ahead + behind >= np.maximum(p, least - p)
            found.append(np.stack([(a - behind)[ok], (b + ahead)[ok], p[ok]]))
    every = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    fresh = np.ones(every.shape[1], bool)
    fresh[1:] = (every[0, 1:] != every[0, :-1]) | (every[1, 1:] != every[1, :-1])
    s, e, p = every[:, fresh]
    return s, e, p


def runs_of(texts: list[list[bytes]], words: np.ndarray, before: np.ndarray, least: int = LEAST) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) by start, then period. ``words`` are hashes of all words, used by the mask only."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts, ends = surviving(words, before, least)
    if not len(starts):
        return out
    owner = np.searchsorted(before, starts, side="right") - 1
    number: dict[bytes, int] = {}
    laid, first, at = [], [], 1
    for t, a, b in zip(owner.tolist(), starts.tolist(), ends.tolist(), strict=True):
        base = int(before[t])
        laid.append([number.setdefault(w, len(number)) for w in texts[t][a - base : b - base]])
        first.append(at)
        at += b - a + 1
    x = np.empty(at, np.int64)
    x[0] = -1
    for i, (a, ids) in enumerate(zip(first, laid, strict=True)):
        x[a : a + len(ids)] = ids
        x[a + len(ids)] = -2 - i
    first = np.array(first)
    s, e, p = main_lorentz(x, first, first + (ends - starts), least)
    segment = np.searchsorted(first, s, side="right") - 1
    local = s - first[segment] + starts[segment] - before[owner[segment]]
    for t, a, n, q in sorted(zip(owner[segment].tolist(), local.tolist(), (e - s).tolist(), p.tolist(), strict=True)):
        out[t].append((a, n, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words but those of a run after its first period, joined by one space."""
    if not runs:
        return b" ".join(words)
    change = np.zeros(len(words) + 1, np.int64)
    for a, n, q in runs:
        change[a + q] += 1
        change[a + n] -= 1
    kept = np.flatnonzero(np.cumsum(change[:-1]) == 0)
    return b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """doc_id, runs (array of start, length, period, by start then period) and the collapsed text of every row."""
    rows = common.pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            ids, texts = batch.column("doc_id"), pc.fill_null(batch.column("text"), "")
            if not len(texts):
                yield pa.RecordBatch.from_arrays([ids, pa.array([], run_type), pa.array([], pa.string())], names=["doc_id", "runs", "collapsed"])
            for a, b, data, offsets in common.text_chunks(texts):
                raw, start, end, before = common.word_spans(data, offsets, lower=False)
                whole, cuts = data.tobytes(), offsets.tolist()
                words = [whole[i:j].split() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
                runs = runs_of(words, common.span_hashes(raw, start, end), before, least)
                kept = [collapsed(w, r).decode("utf-8") for w, r in zip(words, runs, strict=True)]
                listed = [[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(listed, run_type), pa.array(kept, pa.string())], names=["doc_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def _rewritten(doc_id: Column, text: Column) -> Column:
    """The text in which, for one id hash of ten, the words from ``a`` on repeat with period ``p``."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, _SPACES), lambda w: w != "")
    # The array is handed to one lambda, so it is made once a row.
    whole = lambda w: F.size(w).cast("bigint")
    start = lambda w: g % whole(w)
    period = lambda w: F.floor((whole(w) - start(w)) / (F.lit(3) + g % 8)) + 1

    def again(w: Column) -> Column:
        facts = F.array(F.struct(start(w).alias("a"), period(w).alias("p")))
        return F.flatten(F.transform(facts, lambda f: F.transform(w, lambda word, i: F.when(i < f["a"], word).otherwise(F.get(w, (f["a"] + (i - f["a"]) % f["p"]).cast("int"))))))

    joined = F.array_join(F.flatten(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, again(w)).otherwise(w))), " ")
    return F.when(h % 10 == 0, joined).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = periodic_runs(docs.select("doc_id", _rewritten(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("minus"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = found.withColumn("best", longest)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.before")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.minus")).alias("period"),
        F.floor(F.col("best.length") * 1000 / -F.col("best.minus")).cast("bigint").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
