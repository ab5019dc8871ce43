"""N-gram Jaccard join: documents link when the Jaccard similarity of their shingle sets reaches a threshold.

Rare-first prefix filtering finds candidates: two sets that are similar enough share a shingle among the first
``n - ceil(t n) + 1`` of any common order. Shingles come in the order of how far their bucket of a count sketch of
the corpus stands out, then of their words' frequencies (a second sketch), then of their hash. Sets meet in groups of one prefix
shingle and one class of lengths. In a small group every pair passes the length and positional filters, each
distinct pair then the suffix filter (the overlap that histograms of both sets allow) and a finer one, for which one set travels as a histogram
of a sixteenth of its size to the other one. Pairs that are left, mostly links, are verified once on their full sets.

A larger group lists no pairs. The set that most of its large groups share becomes its hub, every member is compared with the hub in full, and members that
link take its label. Any other pair of the group is a question about differences: with A and B the shingles in which two sets differ
from the hub, the sets differ from each other in the symmetric difference of A and B. So the same prefix and positional filters apply
to A and B, in the order of how many members of the hub have a difference, and members meet again in groups of one of them, which are far
smaller: copies of one text differ in different places, and what all have but the hub comes last. Members that both link to the hub need no
comparison, which halves the prefixes of those that do.
This goes on until no large group of several labels is left. Every pair that can link is thus verified, or both its
sets are known to be connected; work grows with the members of a group, not with its pairs.

Defined results: null and empty texts, and texts of white space, have an empty set and link with nothing; repeated rows
fall into one class; rows that share an id but not their text are kept apart. Ids may be null. An empty table gives an empty table.
Extra columns are left out. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constella.llm import common
from constella.operators.components import connected_components

#: Bits of the sketches of shingles and of words; what they miss makes prefixes less rare, not results less whole.
SKETCH_BITS, WORD_BITS = 18, 19
SKETCH, WORDS = 1 << SKETCH_BITS, 1 << WORD_BITS
#: Bins of the suffix filter's histogram.
BINS = 128
#: Sets in a group of one prefix shingle, and in one of one difference from a hub, whose pairs are listed; a larger group gets a hub.
#: The second kind is filtered by how much of the differences must be shared, so that few of its pairs are left.
SMALL, SMALL_APART = 12, 200
#: Members far from one hub whose pairs are listed; of more than that a prefix of each one's differences is.
FAR_MEMBERS = 100
#: Members of a hub that are verified together, so that one task needn't hold a large group.
HUB_MEMBERS = 500
#: Bits of one slice of the candidate filter, and keys up to which that filter is broadcast (256 MB then).
SLICE, FILTER_KEYS = 1 << 20, 100_000_000


def _sets(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """Row number and shingle set of each text."""
    for first, _, data, offsets in common.text_chunks(batch.column("text")):
        words, before = common.word_hashes(data, offsets)
        for i, s in enumerate(common.shingle_sets(words, before, width)):
            yield first + i, s


def _key(s: np.ndarray) -> int:
    """A 64-bit key of the whole set."""
    total = common.mix(s).sum(dtype=np.uint64) + np.uint64(len(s))
    return int(common.mix(np.array([total], dtype=np.uint64)).view(np.int64)[0])


def _histogram(s: np.ndarray) -> bytes:
    """Shingles of a set by the upper bits of their hashes, modulo 256."""
    return np.bincount((s >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64), minlength=BINS).astype(np.uint8).tobytes()


def _shape(s: np.ndarray, size: int) -> np.ndarray:
    """A set's histogram in as many bins as ``size`` shingles need to lie in bins of their own mostly; it is kept modulo 16."""
    bits = max(4, (size - 1).bit_length())
    return np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & np.uint8(15)


def _packed(shape: np.ndarray) -> bytes:
    return (shape[::2] | shape[1::2] << np.uint8(4)).tobytes()


def _apart(packed: np.ndarray, shape: np.ndarray) -> int:
    """A lower bound of the number of shingles in which two sets differ, from the packed shape of one and that of the other in the same bins."""
    low, high = (packed & np.uint8(15)) - shape[::2], (packed >> np.uint8(4)) - shape[1::2]
    return sum(int(np.minimum(x & np.uint8(15), -x & np.uint8(15)).sum(dtype=np.int64)) for x in (low, high))


def _word_bucket(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)


def set_facts(source: DataFrame, width: int) -> DataFrame:
    """Size, key and histogram of each text's set; one more row for each task carries its part of both sketches."""
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, schema = np.zeros(SKETCH + WORDS, np.int64), None
        for batch in common.sliced(batches):
            n, keys, hist = [], [], []
            for _, _, data, offsets in common.text_chunks(batch.column("text")):
                words, before = common.word_hashes(data, offsets)
                sketch[SKETCH:] += np.bincount(_word_bucket(words), minlength=WORDS)
                sets = common.shingle_sets(words, before, width)
                n += map(len, sets)
                keys += map(_key, sets)
                hist += map(_histogram, sets)
                sketch[:SKETCH] += np.bincount((np.concatenate(sets) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            nothing = pa.nulls(batch.num_rows, pa.binary())
            out = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int32()), pa.array(keys, pa.int64()), pa.array(hist, pa.binary()), nothing], names=["doc_id", "n", "key", "hist", "sketch"])
            schema = out.schema
            yield out
        if schema is not None:
            part = sketch.astype(np.float32).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((None, None, None, None, part), schema, strict=True)], schema=schema)

    return source.mapInArrow(run, f"doc_id {kind}, n int, key bigint, hist binary, sketch binary")


def corpus_sketches(facts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """How far each shingle bucket stands out (0: not), and the logarithm of each word bucket's count, in 64ths."""
    counts = common.summed(facts.where("sketch is not null"), "sketch", SKETCH + WORDS, "float32")
    shingles, words = counts[:SKETCH], counts[SKETCH:]
    usual = np.median(shingles)
    above = np.maximum(shingles - usual, 0) / (6 * np.sqrt(max(usual, 1.0)))
    return np.minimum(np.floor(np.log2(above + 1)), 31).astype(np.uint8), np.round(64 * np.log2(words + 1)).astype(np.uint16)


def _ordered(words: np.ndarray, width: int, standing: np.ndarray, log_words: np.ndarray) -> np.ndarray:
    """For each shingle a number that holds its place in the order in the upper 20 bits and 44 bits of its hash."""
    full = common.fold(words, width)
    each = log_words[_word_bucket(words)].astype(np.uint64)
    rarity = np.zeros(len(full), np.uint64)
    for i in range(width):
        rarity += each[i : i + len(full)]
    level = standing[(full & np.uint64(SKETCH - 1)).astype(np.int64)].astype(np.uint64)
    return (level << np.uint64(59)) | (np.minimum(rarity // np.uint64(width), np.uint64(32767)) << np.uint64(44)) | (full & np.uint64((1 << 44) - 1))


def prefix_entries(source: DataFrame, width: int, percent: int, sketches: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """(token, key, n, pos) of each set's prefix; copies within a task are listed once."""
    held = source.sparkSession.sparkContext.broadcast(sketches)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in common.sliced(batches):
            token, key, n, pos = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
            for _, _, data, offsets in common.text_chunks(batch.column("text")):
                words, before = common.word_hashes(data, offsets)
                for i, s in enumerate(common.shingle_sets(words, before, width)):
                    if not len(s) or (k := _key(s)) in seen:
                        continue
                    seen.add(k)
                    own = words[before[i] : before[i + 1]]
                    order = np.unique(_ordered(own, min(width, len(own)), *held.value))
                    size = len(s) - -(-percent * len(s) // 100) + 1
                    token.append(order[:size].view(np.int64))
                    key.append(np.full(len(token[-1]), k, np.int64))
                    n.append(np.full(len(token[-1]), len(s), np.int32))
                    pos.append(np.arange(len(token[-1]), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (token, key, n, pos)], names=["token", "key", "n", "pos"])

    return source.mapInArrow(run, "token bigint, key bigint, n int, pos int")


def _filter_bits(ids: np.ndarray, size: int) -> np.ndarray:
    """Three places of each key in a filter of ``size`` bits (a power of two)."""
    salts = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    return (common.mix(ids.view(np.uint64) ^ salts[:, None]) & np.uint64(size - 1)).astype(np.int64)


def candidate_filter(keys: DataFrame, n_keys: int) -> np.ndarray:
    """A Bloom filter of 16 bits or more a key, packed to bytes. Tasks fill slices of it, the driver joins them."""
    size = 1 << max(16, int(np.ceil(np.log2(16 * n_keys + 1))))
    width = min(size, SLICE)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.sliced(batches):
            bits = np.unique(_filter_bits(batch.column("key").to_numpy(zero_copy_only=False).copy(), size).ravel())
            heads = np.flatnonzero(np.diff(bits // width, prepend=-1))
            parts = np.split((bits % width).astype(np.uint32), heads[1:])
            yield pa.RecordBatch.from_arrays([pa.array(bits[heads] // width, pa.int64()), pa.array([x.tobytes() for x in parts][: len(heads)], pa.binary())], names=["slice", "bits"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[int, np.ndarray] = {}
        for batch in common.sliced(batches):
            for at, bits in zip(batch.column("slice").to_pylist(), batch.column("bits"), strict=True):
                slices.setdefault(at, np.zeros(width, bool))[np.frombuffer(bits.as_buffer(), np.uint32)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(slices), pa.int64()), pa.array([np.packbits(x).tobytes() for x in slices.values()], pa.binary())], names=["slice", "bits"])

    placed = keys.select("key").mapInArrow(places, "slice bigint, bits binary").repartition(size // width, "slice")
    out = np.zeros(size // 8, np.uint8)
    for r in placed.mapInArrow(fill, "slice bigint, bits binary").collect():
        out[r["slice"] * (width // 8) :][: width // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def candidate_sets(source: DataFrame, width: int, bits: np.ndarray | None) -> DataFrame:
    """Full sets (key, tokens) of the texts whose key passes the candidate filter, or of all."""
    held = source.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        seen: set[int] = set()
        for batch in common.sliced(batches):
            keys, tokens = [], []
            for _, s in _sets(batch, width):
                if not len(s) or (k := _key(s)) in seen:
                    continue
                if bits is not None:
                    at = _filter_bits(np.array([k], np.int64), 8 * len(bits)).ravel()
                    if not ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all():
                        continue
                seen.add(k)
                keys.append(k)
                tokens.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(tokens, pa.binary())], names=["key", "tokens"])

    return source.mapInArrow(run, "key bigint, tokens binary")


def _needed(n, m, percent: int):
    """Least overlap of sets of n and m shingles that link."""
    return F.ceil(((n + m) * percent).cast("bigint") / F.lit(100 + percent))


def _differences(s: np.ndarray, hub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of a set that its hub lacks, and those of the hub that it lacks."""
    at = np.searchsorted(hub, s)
    inside = hub[np.minimum(at, len(hub) - 1)] == s
    missing = np.ones(len(hub), bool)
    missing[at[inside]] = False
    return s[~inside], hub[missing]


def _widest(n: int, percent: int) -> int:
    """Shingles in which a set of n and one that links with it differ at most."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent)


def _prefix_size(n: int, m: int, shared: int, percent: int) -> tuple[int, bool]:
    """How many of the differences from a hub of m shingles a set of n must show, and whether the two link.

    A set that isn't linked differs from a partner in ``_widest`` shingles at most, so one of that many and one more is shared. A
    linked one only needs partners that aren't: these differ from the hub so much that about half of its own differences must be shared.
    """
    linked = 100 * shared >= percent * (n + m - shared)
    a = n + m - 2 * shared
    if linked:
        least = (a + m - n) / 2 + percent * (n - m) / (100 + percent)
        return a - max(1, int(np.floor(least))) + 1, True
    return min(a, _widest(n, percent) + 1), False


def several_labels(rows: DataFrame, *group: str) -> DataFrame:
    """Rows of the groups that hold several labels, with the number ``c`` of the group's rows."""
    whole = Window.partitionBy(*group)
    rows = rows.withColumns({"c": F.count("*").over(whole), "lo": F.min("label").over(whole), "hi": F.max("label").over(whole)})
    return rows.where("lo < hi").drop("lo", "hi")


def prefix_groups(prefixes: DataFrame, percent: int) -> DataFrame:
    """Groups of one prefix shingle and one class of lengths with several sets: (g, key, n, a, pos, label, c).

    Prefixes are by far the most rows of the join. They are dealt once, by their shingle, and all that follows is done where they are.
    """
    lengths = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    shared = several_labels(prefixes.withColumn("label", F.col("key")), "token").drop("c").distinct()
    rows = several_labels(shared.withColumn("part", F.explode(F.array(lengths, lengths + 1))), "token", "part")
    return rows.select(F.xxhash64("token", "part").alias("g"), "key", "n", F.col("n").alias("a"), "pos", "label", "c")


class _Join:
    """One run of the join: its tables, links and labels so far.

    Rows at each level: ``g`` (the group: a shingle with its length class, or with its hub), key, n, a (size of what is
    listed: the set, or its differences from the hub), pos (place in the order of what is listed), label and c (rows of the group).
    """

    def __init__(self, classes: DataFrame, make_sets: Callable[[DataFrame], DataFrame], percent: int, standing: np.ndarray, stats: dict | None):
        self.classes, self.make_sets, self.percent, self.standing, self.stats = classes, make_sets, percent, standing, stats
        self.sets: DataFrame | None = None
        self.labels: DataFrame | None = None
        self.tested: DataFrame | None = None
        self.links: DataFrame | None = None
        self.written: list[DataFrame] = []

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        out = common.cut(df, name)
        self.written.append(out)
        return out

    def count(self, name: str, df: DataFrame) -> None:
        if self.stats is not None:
            self.stats[name] = self.stats.get(name, 0) + df.count()

    def grouped(self, entries: DataFrame) -> DataFrame:
        """Entries of the groups that hold several labels, with their label and the group's size ``c``; one exchange, by the group."""
        whole = Window.partitionBy("g")
        rows = entries.join(self.labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
        # The positional filter for the group as a whole: no partner can list more than ``most`` shingles.
        ends = (F.col("n") + F.floor(F.col("n") * 100 / self.percent)) * (100 - self.percent) / (100 + self.percent)
        rows = rows.withColumn("most", F.col("a") + F.floor(ends) - 2 * F.col("pos"))
        rows = rows.withColumns({"least_a": F.min("a").over(whole), "most_a": F.max("most").over(whole)})
        rows = rows.where("most >= least_a and a <= most_a").drop("most", "least_a", "most_a")
        return self.cut(several_labels(rows, "g"), "groups")

    def pairs(self, rows: DataFrame, most: int) -> DataFrame:
        """Distinct pairs of the groups of ``most`` sets at most after the length and positional filters that weren't tested before."""
        small = rows.where(F.col("c") <= most)
        other = small.select("g", *[F.col(c).alias("o" + c) for c in ("key", "n", "a", "pos", "label")])
        n, m = F.col("n"), F.col("on")
        # What has to be shared of the listed shingles: the overlap that a link needs, less what both have in common with the hub.
        shared = (F.col("a") + F.col("oa") - n - m) / 2 + _needed(n, m, self.percent)
        near = (F.least(n, m) * 100 >= F.greatest(n, m) * self.percent) & (F.least(F.col("a") - F.col("pos"), F.col("oa") - F.col("opos")) >= shared)
        found = small.join(other, "g").where((F.col("key") < F.col("okey")) & (F.col("label") != F.col("olabel")) & near)
        found = found.select(F.col("key").alias("a"), F.col("okey").alias("b")).distinct()
        if self.tested is not None:
            found = found.join(self.tested, ["a", "b"], "left_anti")
        return self.cut(found, "pairs")

    def members(self, rows: DataFrame, most: int, first: bool) -> DataFrame:
        """(fam, key, hub) of the larger groups: the hub is the member of most large groups.

        Groups of one hub become one family where they are made of prefixes; later each stays by itself, so that the groups that follow from it
        have fewer members than it has and the levels come to an end.
        """
        large = rows.where(F.col("c") > most).select("g", "key")
        often = large.groupBy("key").agg(F.count("*").alias("often"))
        ranked = large.join(often, "key")
        best = ranked.groupBy("g").agg(F.max(F.struct("often", F.xxhash64("key").alias("h"), F.col("key").alias("hub"))).alias("b")).select("g", "b.hub")
        fam = F.lit(0).cast("bigint") if first else F.col("g")
        return self.cut(large.join(best, "g").where("key <> hub").select(fam.alias("fam"), "key", "hub").distinct(), "members")

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs that pass the suffix filter: how much their histograms differ allows for a link."""
        percent = self.percent
        mine = self.classes.select(F.col("key").alias("a"), "n", "hist")
        theirs = self.classes.select(F.col("key").alias("b"), F.col("n").alias("on"), F.col("hist").alias("ohist"))

        def suffix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("hist", "ohist"))
                n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "on"))
                # Bins are kept modulo 256: the distance on that circle is a lower bound of the true one.
                apart = np.minimum(x - y, y - x).sum(axis=1, dtype=np.int64)
                needed = -(-percent * (n + m) // (100 + percent))
                yield batch.select(["a", "b"]).filter(pa.array(apart <= n + m - 2 * needed))

        joined = pairs.join(mine, "a").join(theirs, "b").select("a", "b", "n", "on", "hist", "ohist")
        return self.cut(joined.mapInArrow(suffix, "a bigint, b bigint"), "likely")

    def verify(self, likely: DataFrame, pairs: DataFrame) -> None:
        """Full comparison of the likely ones of some pairs, after one by shapes; links are kept."""
        percent = self.percent

        def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("tokens")]
                columns = [pa.array([len(s) for s in sets], pa.int32()), pa.array([_packed(_shape(s, len(s))) for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *columns], names=["a", "b", "n", "shape"])

        def allowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                good = []
                for n, x, y in zip(batch.column("n").to_pylist(), batch.column("shape"), batch.column("other"), strict=True):
                    t = np.frombuffer(y.as_buffer(), np.uint64)
                    needed = -(-percent * (n + len(t)) // (100 + percent))
                    good.append(_apart(np.frombuffer(x.as_buffer(), np.uint8), _shape(t, n)) <= n + len(t) - 2 * needed)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in common.sliced(batches):
                good = []
                for x, y in zip(batch.column("tokens"), batch.column("other"), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    shared = len(np.intersect1d(s, t, assume_unique=True))
                    good.append(100 * shared >= percent * (len(s) + len(t) - shared))
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

        mine, theirs = self.sets.select(F.col("key").alias("a"), "tokens"), self.sets.select(F.col("key").alias("b"), F.col("tokens").alias("other"))
        # Only a shape of ``a`` travels to ``b``; whole sets of the pairs that it leaves do.
        shaped = likely.join(mine, "a").select("a", "b", "tokens").mapInArrow(shapes, "a bigint, b bigint, n int, shape binary")
        close = self.cut(shaped.join(theirs, "b").select("a", "b", "n", "shape", "other").mapInArrow(allowed, "a bigint, b bigint"), "close")
        self.count("close", close)
        matched = close.join(mine, "a").join(theirs, "b").select("a", "b", "tokens", "other")
        self.keep(self.cut(matched.mapInArrow(compare, "a bigint, b bigint"), "links"), pairs)
        self.count("pairs", pairs)
        common.drop(likely, close)
        common.release(self.sets.sparkSession)

    def keep(self, links: DataFrame, tested: DataFrame) -> None:
        links, tested = links.select("a", "b"), tested.select("a", "b")
        self.links = links if self.links is None else self.links.unionByName(links)
        self.tested = tested if self.tested is None else self.tested.unionByName(tested)

    def compare_with_hubs(self, pairs: DataFrame) -> DataFrame:
        """Full comparison of members with their hub: (key, hub, far, n, a, linked, size, apart).

        ``a`` is the number of differences and ``size`` how many of them have to show. A member near its hub lists all of them, one that is far
        the first ``size``: what the hub lacks, by how much its bucket of the sketch stands out. Two sets whose ``a`` are further apart than a
        partner's differences can't link, so near and far members are families of their own, and those between are in both.
        """
        percent, held = self.percent, self.sets.sparkSession.sparkContext.broadcast(self.standing)
        # A hub with many members is repeated, once for every HUB_MEMBERS of them, so that no task gets them all.
        parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / HUB_MEMBERS).cast("int").alias("parts"))
        dealt = pairs.join(parts, "hub").select("key", "hub", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"))
        hubs = self.sets.select(F.col("key").alias("hub"), F.col("tokens").alias("other")).join(parts, "hub")
        hubs = hubs.select("hub", "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        joined = dealt.join(self.sets.select("key", "tokens"), "key").join(hubs, ["hub", "part"]).select("key", "hub", "tokens", "other")
        schema = pa.schema([("key", pa.int64()), ("hub", pa.int64()), ("far", pa.bool_()), ("n", pa.int32()), ("a", pa.int32()), ("linked", pa.bool_()), ("size", pa.int32()), ("apart", pa.list_(pa.int64()))])

        def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            standing = held.value
            for batch in common.sliced(batches):
                rows = []
                for key, hub_key, x, y in zip(*[batch.column(c) for c in ("key", "hub", "tokens", "other")], strict=True):
                    s, hub = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    more, less = _differences(s, hub)
                    a, near = len(more) + len(less), 2 * _widest(len(hub), percent)
                    size, linked = _prefix_size(len(s), len(hub), len(s) - len(more), percent)
                    facts = (len(s), a, linked, size)
                    if a <= near + _widest(len(s), percent):
                        rows.append((key.as_py(), hub_key.as_py(), False, *facts, np.concatenate([more, less]).view(np.int64)))
                    if a > near:
                        order = np.lexsort((more, standing[(more & np.uint64(SKETCH - 1)).astype(np.int64)]))
                        rows.append((key.as_py(), hub_key.as_py(), True, *facts, np.concatenate([more[order[:size]], less])[:size].view(np.int64)))
                columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

        out = self.cut(joined.mapInArrow(differ, "key bigint, hub bigint, far boolean, n int, a int, linked boolean, size int, apart array<bigint>"), "differences")
        ends = [F.least("key", "hub").alias("a"), F.greatest("key", "hub").alias("b")]
        self.keep(out.where("linked").select(*ends), out.select(*ends))
        self.count("hub_pairs", pairs)
        return out

    def relabel(self) -> None:
        """Every set on a link takes a small key near it: the smallest within two links, and then that one's. Equal labels are connected."""
        both = self.links.union(self.links.select("b", "a")).toDF("key", "other")
        near = both.groupBy("key").agg(F.least(F.min("other"), F.col("key")).alias("label"))
        further = both.join(near.toDF("other", "label"), "other").groupBy("key").agg(F.min("label").alias("label"))
        further = self.cut(further, "near")
        jump = further.toDF("label", "far")
        self.labels = self.cut(further.join(jump, "label", "left").select("key", F.coalesce("far", "label").alias("label")), "labels")

    def differing(self, members: DataFrame, apart: DataFrame) -> DataFrame:
        """Entries of the next level: prefixes of the differences, for near members those first that few of the family have.

        Differences that one member alone has come before all others and lead nowhere, so they are only counted. A few members far from one
        hub are a group as they are, since pairs of them are fewer than the differences that they would have to show.
        """
        listed = members.join(apart, ["key", "hub"])
        group = F.xxhash64("fam", "hub", "token", "far").alias("g")
        few = members.join(apart.where("far").select("key", "hub"), ["key", "hub"]).groupBy("fam", "hub").agg((F.count("*") <= FAR_MEMBERS).alias("few"))
        away = listed.where("far").join(few, ["fam", "hub"])
        together = away.where("few").select(F.xxhash64("fam", "hub").alias("g"), "key", "n", F.col("n").alias("a"), F.lit(0).alias("pos"))
        far = away.where("not few").select("fam", "hub", "far", "key", "n", "a", F.posexplode("apart").alias("pos", "token"))
        every = listed.where("not far").select("fam", "hub", "far", "key", "n", "a", "size", F.explode("apart").alias("token"))
        several = every.groupBy("fam", "hub", "token").agg(F.count("*").alias("f")).where("f > 1")
        rows = every.join(several, ["fam", "hub", "token"])
        own = Window.partitionBy("fam", "hub", "key")
        place = F.row_number().over(own.orderBy("f", "token")) - 1 + F.col("a") - F.count("*").over(own)
        near = rows.withColumn("pos", place.cast("int")).where("pos < size")
        return near.select(group, "key", "n", "a", "pos").unionByName(far.select(group, "key", "n", "a", "pos")).unionByName(together)

    def run(self, rows: DataFrame) -> None:
        most, first = SMALL, True
        while True:
            pairs = self.pairs(rows, most)
            likely = self.likely(pairs)
            members = self.members(rows, most, first)
            if first:
                # Whole sets are only made of what is to be compared; later levels compare members of this one.
                ends = [likely.select(F.col(c).alias("key")) for c in ("a", "b")] + [members.select(F.col(c).alias("key")) for c in ("key", "hub")]
                self.sets = self.make_sets(self.cut(ends[0].union(ends[1]).union(ends[2]).union(ends[3]).distinct(), "keys"))
            self.verify(likely, pairs)
            if members.isEmpty():
                return
            apart = self.compare_with_hubs(members.select("key", "hub").distinct())
            self.relabel()
            common.drop(rows)
            rows = self.grouped(self.differing(members, apart))
            most, first = SMALL_APART, False
            common.release(rows.sparkSession)


def ngram_join(df: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 80, stats: dict | None = None) -> DataFrame:
    """One row for each text: doc_id, n_shingles, class_id (smallest id of its equal sets), component_id (smallest reachable id).

    ``stats``, if given, gets the numbers of compared pairs.
    """
    spark = df.sparkSession
    source = common.pick(df, doc_id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
    written = common.cut(set_facts(source, width), "sets")
    sketches = corpus_sketches(written)
    facts = written.where("n is not null").select("doc_id", "n", "key")
    filled = facts.where("n > 0")
    classes = common.cut(written.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("class_id"), F.first("n").alias("n"), F.first("hist").alias("hist")), "classes")
    groups = common.cut(prefix_groups(prefix_entries(source, width, percent, sketches), percent), "groups")
    common.release(spark)
    name, path = f"t_{uuid.uuid4().hex}", common.new_path(spark, "buckets")

    def make_sets(keys: DataFrame) -> DataFrame:
        """Sets of the keys, written once in buckets, so that joining by the key needs no further exchange of whole sets."""
        n_keys = keys.count()
        if n_keys <= FILTER_KEYS:
            full = candidate_sets(source, width, candidate_filter(keys, n_keys))
        else:
            first = classes.join(keys, "key", "left_semi").select("class_id")
            full = candidate_sets(source.join(first, F.col("doc_id").eqNullSafe(F.col("class_id")), "left_semi"), width, None)
        buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        full = full.repartition(buckets, "key").dropDuplicates(["key"])
        full.write.option("path", path).option("compression", "zstd").bucketBy(buckets, "key").sortBy("key").saveAsTable(name)
        common.release(spark)
        return spark.table(name)

    join = _Join(classes, make_sets, percent, sketches[0], stats)
    join.run(groups)
    links = common.cut(join.links, "all-links")
    if links.isEmpty():
        groups = classes.select("key", "class_id", F.col("class_id").alias("component_id"))
    else:
        ends = links.select(F.col("a").alias("src"), F.col("b").alias("dst"))
        nodes = ends.select(F.col("src").alias("id")).union(ends.select("dst")).distinct()
        labels = connected_components(nodes, ends).select(F.col("id").alias("key"), F.col("component").alias("label"))
        placed = classes.select("key", "class_id").join(labels, "key", "left").select("key", "class_id", F.coalesce("label", "key").alias("label"))
        groups = placed.join(placed.groupBy("label").agg(F.min("class_id").alias("component_id")), "label").select("key", "class_id", "component_id")
    out = filled.join(groups, "key").select("doc_id", F.col("n").cast("bigint").alias("n_shingles"), "class_id", "component_id")
    alone = facts.where("n = 0").select("doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = common.cut(out.unionByName(alone), "joined")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    common.drop_path(spark, path)
    common.drop(written, classes, links, *join.written)
    common.release(spark)
    return out


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.table(spark, sf_dir, "documents"), "doc_id", "text", width=3, percent=90).select("doc_id", "n_shingles", "component_id")
