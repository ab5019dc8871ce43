"""The n-gram join on large groups of near copies, with hubs at several levels, against full comparison."""

import numpy as np
from pyspark.sql import functions as F

from constella.llm import ngram_join


def components_of(texts, width, percent):
    """Smallest index of each text's component, from the matrix of all overlaps."""
    sets = [{tuple(w[i : i + width]) for i in range(len(w) - width + 1)} for w in (t.split() for t in texts)]
    seen: dict = {}
    for s in sets:
        for x in s:
            seen[x] = seen.get(x, 0) + 1
    column = {x: i for i, x in enumerate(x for x, c in seen.items() if c > 1)}
    matrix = np.zeros((len(texts), len(column)), np.float32)
    for row, s in zip(matrix, sets, strict=True):
        row[[column[x] for x in s if x in column]] = 1
    both = matrix @ matrix.T
    n = np.array([len(s) for s in sets])
    linked = 100 * both >= percent * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, True)
    label = np.arange(len(texts))
    while True:
        following = np.array([label[row].min() for row in linked])
        if (following == label).all():
            return label.tolist()
        label = following


def copies(rng, count, length, most, name):
    """Copies of one text, each with up to ``most`` words changed; some changes are shared by many copies, the original isn't among them."""
    base = [f"{name}{i}" for i in range(length)]
    out = []
    for i in range(count):
        words = list(base)
        for at in rng.choice(length, int(rng.integers(1, most + 1)), replace=False):
            words[at] = f"{name}x{i}x{at}"
        if i % 5 == 0:
            words[7] = f"{name}shared"
        if i % 7 == 0:
            words[40:43] = [f"{name}other", "one", "two"]
        out.append(" ".join(words))
    return out


def test_every_level_of_hubs(spark, monkeypatch):
    width, percent = 3, 90
    monkeypatch.setattr(ngram_join, "SMALL", 4)
    monkeypatch.setattr(ngram_join, "SMALL_APART", 8)
    monkeypatch.setattr(ngram_join, "HUB_MEMBERS", 20)
    monkeypatch.setattr(ngram_join, "FAR_MEMBERS", 9)
    rng = np.random.default_rng(21)
    passage = " ".join(f"passage{i}" for i in range(60))
    texts = copies(rng, 40, 100, 5, "a")
    texts += [f"{passage} " + " ".join(rng.choice([f"w{k}" for k in range(400)], int(rng.integers(3, 30)))) for _ in range(25)]
    want = components_of(texts, width, percent)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("g", F.lit("x")).repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, "doc_id", "text", width, percent).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_work_grows_with_members_not_pairs(spark):
    rng = np.random.default_rng(22)
    texts = copies(rng, 800, 150, 6, "c")
    stats: dict = {}
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.ngram_join(df, "doc_id", "text", 3, 90, stats).collect()}
    assert [got[i] for i in range(len(texts))] == components_of(texts, 3, 90)
    assert stats["pairs"] + stats["hub_pairs"] < 20 * len(texts), stats


def test_sets_without_the_broadcast_filter(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "FILTER_KEYS", 0)
    rng = np.random.default_rng(23)
    texts = copies(rng, 30, 80, 3, "d")
    df = spark.createDataFrame([*enumerate(texts), (None, texts[0] + " more")], "doc_id bigint, text string")
    want = components_of([*texts, texts[0] + " more"], 3, 90)
    got = ngram_join.ngram_join(df, "doc_id", "text", 3, 90).collect()
    assert {r.doc_id: r.component_id for r in got} == {**dict(enumerate(want[:-1])), None: want[-1]}


def test_prefixes_are_dealt_once(spark):
    rows = [(1, 10, 9, 0), (1, 11, 9, 1), (1, 11, 9, 1), (2, 10, 9, 1), (3, 12, 100, 0), (3, 10, 9, 2)]
    found = ngram_join.prefix_groups(spark.createDataFrame(rows, "token bigint, key bigint, n int, pos int"), 80)
    # Equal rows count once; shingles of one set, and sets of other length classes, make no group.
    assert sorted((r.key, r.n, r.a, r.pos, r.label, r.c) for r in found.collect()) == 2 * [(10, 9, 9, 0, 10, 2)] + 2 * [(11, 9, 9, 1, 11, 2)]
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_shapes_bound_differences():
    rng = np.random.default_rng(24)
    for n, m, shared in [(1, 1, 0), (1, 1, 1), (20, 30, 15), (3000, 2800, 2700), (500, 9000, 400), (40_000, 41_000, 0)]:
        pool = rng.integers(0, 1 << 64, n + m - shared, np.uint64)
        s, t = np.sort(pool[:n]), np.sort(pool[n - shared :])
        apart = ngram_join._apart(np.frombuffer(ngram_join._packed(ngram_join._shape(s, n)), np.uint8), ngram_join._shape(t, n))
        exact = n + m - 2 * shared
        assert apart <= exact
        assert apart >= exact / 3 or max(n, m) > 2 * min(n, m) or n == 1


def test_whole_sets_of_links_only_travel(spark):
    rng = np.random.default_rng(25)
    common, sets = rng.integers(0, 1 << 64, 2000, np.uint64), {}
    for k in range(8):
        sets[k] = np.sort(np.concatenate([common, rng.integers(0, 1 << 64, 1000, np.uint64)]))
    sets[8] = sets[0][5:]
    ends = [(a, b) for a in sets for b in sets if a < b]
    stats: dict = {}
    join = ngram_join._Join(None, None, 80, None, stats)
    join.sets = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sets.items()], "key bigint, tokens binary")
    pairs = spark.createDataFrame(ends, "a bigint, b bigint")
    join.verify(pairs, pairs)
    assert [tuple(r) for r in join.links.collect()] == [(0, 8)]
    # Histograms of 128 bins can't tell these pairs apart; all 36 whole sets were sent before.
    assert stats == {"pairs": 36, "close": 1}
