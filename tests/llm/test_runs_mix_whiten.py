"""Periodic runs, mixing and whitening against plain versions, and their defined results on odd input."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from constella.llm import common, mixing, periodic, whitening

SF = "/root/testdata/sf0.001"
ODD = [(1, None, None), (2, "", "a"), (3, " \n\t", "a"), (4, "x", ""), (4, "x", ""), (None, "a null id", "b"), (None, "a null id", None), (5, "long word " * 5000, "b"), (6, "é é " * 70, "ä")]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and extra columns with names that operators use inside."""
    rows = [(*r, 1, 2, "x", 3) for r in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, size int, number int, runs string, first int")


# --- periodic runs -----------------------------------------------------------------------------


def plain_runs(words, least=12):
    """Every period, every stretch; of periods of one stretch the smallest."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                out.setdefault((i, j + q), q)
            i = j + 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def found_runs(texts, least=12):
    out = []
    for _, _, data, offsets in common.text_chunks(pa.array([b" ".join(w).decode() for w in texts])):
        raw, start, end, before = common.word_spans(data, offsets, lower=False)
        words = [data.tobytes()[a:b].split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        out += periodic.runs_of(words, common.span_hashes(raw, start, end), before, least)
    return out


def test_runs_equal_all_periods():
    draw = random.Random(3)
    for _ in range(150):
        texts = []
        for _ in range(draw.randint(1, 6)):
            n, kinds = draw.randint(0, 120), draw.choice([1, 2, 3, 30])
            words = [b"w%d" % draw.randrange(kinds) for _ in range(n)]
            if n and draw.random() < 0.5:
                a = draw.randrange(n)
                p = draw.randint(1, max(1, (n - a) // 2))
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            texts.append(words)
        least = draw.choice([12, 12, 5, 2])
        assert found_runs(texts, least) == [plain_runs(w, least) for w in texts]


def test_runs_of_repetitive_words():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 600:
        a, b = b, b + a
    assert found_runs([b]) == [plain_runs(b)]
    assert found_runs([[b"a"] * 30_000]) == [[(0, 30_000, 1)]]


def test_mask_keeps_what_runs_need_only():
    words = [f"u{i}" for i in range(3000)]
    words[1000:1040] = [f"v{i % 7}" for i in range(40)]
    _, start, end, before = common.word_spans(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    hashes, _ = common.word_hashes(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    assert [x.tolist() for x in periodic.surviving(hashes, before)] == [[1000], [1040]]


def rewritten(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_periodic_query(spark):
    found = {r.doc_id: r for r in periodic.op11_periodic_runs(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    assert len(found) == len(rows)
    some = 0
    for doc_id, text in rows:
        words = rewritten(doc_id, text)
        if len(words) > 1200:
            continue
        runs, got = plain_runs(words), found[doc_id]
        gone = {i for a, n, q in runs for i in range(a + q, a + n)}
        assert got.n_runs == len(runs)
        assert got.runs_sha256 == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in runs).encode()).hexdigest()
        assert got.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        assert (got.start, got.length, got.period, got.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        some += bool(runs)
    assert some > 10


def test_periodic_odd(spark, odd):
    got = periodic.periodic_runs(odd).collect()
    assert len(got) == len(ODD)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert [tuple(r) for r in by[5][0].runs] == [(0, 10_000, 2)] and by[5][0].collapsed == "long word"
    assert [tuple(r) for r in by[6][0].runs] == [(0, 70, 1)] and by[6][0].collapsed == "é é"
    assert [r.collapsed for r in by[4]] == ["x", "x"] and by[1][0].collapsed == by[3][0].collapsed == "" and by[1][0].runs == []
    assert len(by[None]) == 2
    assert periodic.periodic_runs(odd.limit(0)).count() == 0


# --- mixing ------------------------------------------------------------------------------------


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    for sizes in ([5, 1000, 0, 7], [1], [], [0, 0], [10] * 7, [1, 10**9, 3, 10**6]):
        got, total = mixing.targets(sizes), 1.5 * sum(sizes)
        assert sum(got) == pytest.approx(total)
        weight = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
        free = [g / w for g, w, n in zip(got, weight, sizes, strict=True) if g < 2 * n]
        assert all(g <= 2 * n for g, n in zip(got, sizes, strict=True))
        # All that are free have the same share of their weight, and the capped ones would have more.
        assert not free or (max(free) == pytest.approx(min(free)) and all(2 * n / w <= max(free) * (1 + 1e-9) for g, w, n in zip(got, weight, sizes, strict=True) if g >= 2 * n))


def test_permutation(spark):
    for n in (1, 2, 3, 64, 1000):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5))).collect()]
        assert sorted(got) == list(range(n))
        assert n < 64 or sum(a == b for a, b in enumerate(got)) < 10


def test_alias_shares():
    slots = [7, 0, 1, 30, 12]
    stays = Counter()
    for cell, (stay, other) in enumerate(mixing._alias(slots)):
        stays[cell] += stay
        stays[other] += sum(slots) - stay
    assert [stays[i] for i in range(5)] == [s * 5 for s in slots]


def test_mix_meets_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mix = mixing.mix_sources(docs, block_words=16, shard_slots=64)
    spans = mix.spans.collect()
    info = {(r.number, r.first): r for r in mix.documents.where("size > 0").collect()}
    assert len(info) == docs.where(F.length(F.trim("text")) > 0).count()
    of_source, taken, slots = Counter(), Counter(), defaultdict(list)
    for r in spans:
        d = info[(r.number, r.first)]
        assert 0 <= r.first_word and r.first_word + r.n_words <= d["size"] and r.n_words > 0
        of_source[r.number] += r.n_words
        taken[(r.number, r.first)] += r.n_words
        slots[(r.shard, r.slot)].append((r.number, r.first + r.first_word, r.n_words))
    for r in info.values():
        assert abs(of_source[r.number] - r.target) <= 0.5 and taken[(r.number, r.first)] <= 2 * r["size"]
    # Every slot is one block of one source, shards are full but for the last.
    blocks = Counter()
    for pieces in slots.values():
        pieces.sort()
        assert len({n for n, _, _ in pieces}) == 1 and pieces[0][1] % 16 == 0 and sum(p[2] for p in pieces) <= 16
        assert all(a[1] + a[2] == b[1] for a, b in zip(pieces, pieces[1:], strict=False))
        blocks[pieces[0][:2]] += 1
    assert max(blocks.values()) <= 2
    sizes = Counter(s for s, _ in slots)
    assert all(sizes[s] == 64 for s in range(max(sizes)))
    # Counts of a source in a shard look like draws: their spread is near that of a multinomial.
    numbers = {k: v[0][0] for k, v in slots.items()}
    top, n_top = Counter(numbers.values()).most_common(1)[0]
    share, full = n_top / len(slots), [s for s in sizes if sizes[s] == 64]
    counts = [sum(numbers[(s, i)] == top for i in range(64)) for s in full]
    assert 0.3 < np.var(counts) / (64 * share * (1 - share)) < 2.5
    again = mixing.mix_sources(docs.repartition(7), block_words=16, shard_slots=64).spans
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, spans))


def test_mixed_words(spark):
    docs = spark.createDataFrame([(i, " ".join(f"d{i}w{j}" for j in range(3 + 5 * i)), "s" if i % 3 else None) for i in range(12)], "doc_id int, text string, source string")
    mix = mixing.mix_sources(docs, block_words=4, shard_slots=5)
    for r in mixing.mixed_words(mix, docs).collect():
        words = r.words.split(" ")
        assert words == [f"d{r.doc_id}w{r.first_word + j}" for j in range(len(words))]


def test_mix_broadcasts_no_table_of_documents(spark):
    docs = spark.createDataFrame([(i, "a b c d e f", "xy"[i % 2]) for i in range(20)], "doc_id bigint, text string, source string")
    mix = mixing.mix_sources(docs, block_words=4, shard_slots=5)
    for table in (mix.spans, mixing.mixed_words(mix, docs)):
        joins = [line for line in table._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in line]
        assert joins and not [line for line in joins if any(c in line for c in ("block#", "_gift#", "first#", "doc_id#"))]


def test_mix_odd(spark, odd):
    mix = mixing.mix_sources(odd)
    rows = mix.documents.collect()
    assert len(rows) == len(ODD) and {r.source: r.number for r in rows} == {"": 0, "a": 1, "b": 2, "ä": 3, None: 4}
    total = sum(r["size"] for r in rows)
    assert total == 2 + 3 + 3 + 10_000 + 70
    per = dict(mix.spans.groupBy("number").agg(F.sum("n_words")).collect())
    for r in rows:
        assert abs(per.get(r.number, 0) - r.target) <= 0.5 and (r.source != "a" or r.target == 0)
    empty = mixing.mix_sources(odd.limit(0))
    assert empty.documents.count() == empty.spans.count() == 0
    blank = mixing.mix_sources(odd.where("doc_id in (1, 2, 3)"))
    assert blank.documents.count() == 3 and blank.spans.count() == 0


def test_mix_query(spark):
    docs = {r.doc_id: (len((r.text or "").encode().split()), r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    of_source = Counter()
    for n, s in docs.values():
        of_source[s] += n
    names = sorted(of_source, key=lambda s: (s is None, s or ""))
    wanted, taken = dict(zip(names, mixing.targets([of_source[s] for s in names]), strict=True)), Counter()
    got = mixing.op12_mixed_sources(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        n, s = docs[r.doc_id]
        assert (r["size"], r.source_size, r.target) == (n, of_source[s], wanted[s]) and 0 <= r.taken <= 2 * n
        taken[s] += r.taken
    assert all(abs(taken[s] - wanted[s]) <= 0.5 for s in names)


# --- whitening ---------------------------------------------------------------------------------


def plain_whitening(vectors, count=16):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    fit = sorted({tuple(v) for v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    rows = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, q = np.linalg.eigh(rows.T @ rows / n)
    values, q = values[::-1][:count], q[:, ::-1][:, :count]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    return n, deviation, np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x]) @ q / np.sqrt(values), values / np.trace(rows.T @ rows / n)


def same_whitening(found, ids, vectors, count=16):
    n, deviation, white, share = plain_whitening(vectors, count)
    rows = sorted((r.vec_id, r.component, r) for r in found)
    assert [(a, b) for a, b, _ in rows] == sorted((i, c) for i in ids for c in range(1, white.shape[1] + 1))
    got = np.array([r.whitened for *_, r in rows]).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    sign = np.sign((got * white[order]).sum(axis=0))
    assert np.abs(got * sign - white[order]).max() < 1e-9
    assert [r.deviation for *_, r in rows][:: white.shape[1]] == [deviation[i] for i in order]
    assert {r.n for *_, r in rows} == {n} and max(r.identity_error for *_, r in rows) < 1e-12
    assert np.allclose([r.explained for *_, r in rows[: white.shape[1]]], share, rtol=1e-12)


def test_whitening_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    same_whitening(whitening.op13_embedding_whitening(spark, SF).collect(), [i for i, _ in rows], [v for _, v in rows])


def test_whitening_narrow_block(spark):
    """A falling spectrum is certified without a block of all dimensions."""
    random_ = np.random.default_rng(4)
    vectors = (random_.standard_normal((300, 90)) * 40 * 0.6 ** np.arange(90)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id int, embedding array<double>")
    same_whitening(whitening.whiten(df, count=4).collect(), list(range(300)), vectors, 4)
    fit = whitening.integer_vectors(df, "vec_id", "embedding").select("x").distinct()
    model = whitening.fit_whitening(common.cut(fit, "fit"), 90, 4)
    assert max(model.widths) < 90 and len(model.widths) > 2 and model.residuals.max() <= whitening.TOLERANCE


def test_whitening_odd(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (3, None), (4, [1.0, None]), (5, [nan, 1.0]), (6, [1.0, inf]), (7, []), (8, [1.0, 2.0, 3.0]), (9, [4.0, 0.0]), (9, [4.01, 0.0])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id int, embedding array<double>, n int, x double")
    got = whitening.whiten(df).collect()
    assert Counter(r.vec_id for r in got) == {1: 4, None: 2, 9: 4} and {r.n for r in got} == {3}
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.where("vec_id = 1")).count() == 0
    huge = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 0.0]), (3, [0.0, 5.0])], "vec_id int, embedding array<double>")
    found = whitening.whiten(huge).collect()
    assert len(found) >= 3 and {r.deviation for r in found if r.vec_id < 3} == {None}


def test_exact_deviation():
    x = np.array([[2**40, 3], [-(2**41), 5], [7, 2**42]], np.int64)
    sums = x.sum(axis=0).tolist()
    rows, deviation = whitening.centred(x, 3, sums)
    exact = [sum((3 * int(c) - s) ** 2 for c, s in zip(r, sums, strict=True)) for r in x.tolist()]
    assert deviation == [d if d < 2**63 else None for d in exact]
    assert np.allclose(rows, x - x.mean(axis=0))
