"""Mixing sources to target weights in fixed-length blocks; DataFrame functions only.

The words of each source, its documents in ascending id order, are one sequence cut into blocks of ``block_words`` (the last may be
shorter). A target of t words becomes slots: whole passes over the source's blocks, then as many blocks as the rest needs, the last cut off at
the target. Each output shard has ``shard_slots`` slots; their sources are drawn at random by the number of slots that each source has, which makes
the counts of a shard multinomial. Where the draws of a source add up to more than its slots, the surplus (random ones, from all shards) goes to
sources that were drawn too seldom, so targets are met to the word. A source's draws are numbered across shards and these numbers mapped through
pseudorandom permutations (swap-or-not): first to a slot of the source, then, for each pass, to a block. Blocks and documents meet in a join by
(source, block). Nothing depends on partitions or on the machine, so reruns agree.

Targets: sources by code point, null last, weigh 3, 1, 2 and again; they share ``share`` of all words; a target stops at ``most`` times
its source's words and the excess is shared by weight among the others, until none is above.

Odd input: null, empty and white texts have size 0 and are never taken; a null source is a source of its own, "" is another; rows that repeat an id (or
all columns) each have their own words; rows with null ids come first in their source; an empty table gives an empty result; extra columns are ignored.
The driver holds one row for each source; tables of documents, blocks and slots are only joined by a shuffle. The table of sources is broadcast while it has
``BROADCAST_SOURCES`` rows at most, and joined by a shuffle beyond.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constella.llm import common

WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 256
SHARD_SLOTS = 1024
BROADCAST_SOURCES = 100_000
#: Shards whose counts one task adds up; sums of such groups are added up in a second step.
SHARD_GROUP = 4096
#: Slots that a task maps, at about: the counts that they are made from are few, so their number says nothing about the work.
TASK_SLOTS = 16_384
#: Rounds of the permutation.
ROUNDS = 24
_WORD = r"[^\x20\x09-\x0D]+"


@dataclass
class Mix:
    """``documents``: doc_id, source, number (of the source), size, source_size, target, first (the document's first word in its source's sequence).
    ``spans``: what the mix takes, in the order of shard, slot and first_word: shard, slot, number, first, first_word (in the document), n_words."""

    documents: DataFrame
    spans: DataFrame


def targets(sizes: list[int], weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0) -> list[float]:
    """Words wanted of each source."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out, left, free = [0.0] * len(sizes), share * sum(sizes), set(range(len(sizes)))
    while free:
        level = left / sum(weight[i] for i in free)
        full = {i for i in free if level * weight[i] > most * sizes[i]}
        for i in full or free:
            out[i] = most * sizes[i] if full else level * weight[i]
        if not full:
            break
        left -= sum(out[i] for i in full)
        free -= full
    return out


def _alias(slots: list[int]) -> list[tuple[int, int]]:
    """For each source the draws (of ``sum(slots)``) that stay with it, and where the others go: a draw costs one look-up."""
    total, n = sum(slots), len(slots)
    have = [c * n for c in slots]
    out = [(total, i) for i in range(n)]
    small, large = [i for i in range(n) if have[i] < total], [i for i in range(n) if have[i] >= total]
    while small and large:
        i, j = small.pop(), large[-1]
        out[i] = (have[i], j)
        have[j] -= total - have[i]
        if have[j] < total:
            small.append(large.pop())
    return out


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 to n - 1 for each key: each round pairs all numbers by a reflection and swaps pairs by a hash bit."""

    def turn(at: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("reflection"), r, *key), n) - at, n)
        return F.when(F.xxhash64(F.lit("swap"), r, F.greatest(at, other), *key) % 2 == 0, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), turn)


def _before(counts: DataFrame, order: str, key: str, value: str, group: int, name: str) -> DataFrame:
    """``counts`` with the sum of ``value`` over all rows of the same ``key`` with smaller ``order``, in two steps, so that no task holds all rows of a key."""
    wide = counts.withColumn("_group", F.floor(F.col(order) / group))
    sums = wide.groupBy(key, "_group").agg(F.sum(value).alias("_sum"))
    sums = sums.withColumn("_base", F.coalesce(F.sum("_sum").over(Window.partitionBy(key).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = Window.partitionBy(key, "_group").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    wide = wide.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return wide.join(_merged(sums.drop("_sum")), [key, "_group"]).withColumn(name, F.col("_base") + F.col("_inner")).drop("_group", "_base", "_inner")


def _few(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def _merged(table: DataFrame) -> DataFrame:
    """``table`` for a join that never broadcasts it: files of few bytes a row look small, and their rows would all go through the driver."""
    return table.hint("merge")


def _located(sizes: DataFrame) -> DataFrame:
    """Documents with the number of words before them in their source: ranges of (source, id), sums of each range, then sums within it."""
    rid = sizes.withColumn("_row", F.monotonically_increasing_id())
    dealt = rid.repartitionByRange("number", "doc_id", "size", "_row").withColumn("_range", F.spark_partition_id())
    dealt = common.cut(dealt, "mix-ranges")
    sums = dealt.groupBy("number", "_range").agg(F.sum("size").alias("_words"))
    sums = _before(sums, "_range", "number", "_words", 1024, "_start")
    within = Window.partitionBy("number", "_range").orderBy("doc_id", "size", "_row").rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("_inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    located = inside.join(_merged(sums.select("number", "_range", "_start")), ["number", "_range"]).withColumn("first", F.col("_start") + F.col("_inside"))
    out = common.cut(located.select("doc_id", "source", "number", "size", "source_size", "target", "first"), "mix-documents")
    common.drop(dealt)
    return out


def _slots(spark: SparkSession, rows: list[dict], sources: DataFrame, block: int, shard_slots: int, seed: int) -> DataFrame:
    """shard, slot, number, block and words (taken from the block's start) of every slot of the output."""
    total, n = sum(r["slots"] for r in rows), len(rows)
    if not total:
        return spark.createDataFrame([], "shard bigint, slot bigint, number int, block bigint, words bigint")
    drawn = spark.range(total).select((F.col("id") / shard_slots).cast("bigint").alias("shard"), F.pmod(F.xxhash64(F.lit("cell"), F.lit(seed), "id"), F.lit(n)).cast("int").alias("cell"), F.pmod(F.xxhash64(F.lit("draw"), F.lit(seed), "id"), F.lit(total)).alias("draw"))
    alias = _few(spark.createDataFrame([(i, r["stay"], r["else"]) for i, r in enumerate(rows)], "cell int, stay bigint, other int"), n)
    drawn = drawn.join(alias, "cell").select("shard", F.when(F.col("draw") < F.col("stay"), F.col("cell")).otherwise(F.col("other")).alias("number"))
    counts = common.cut(drawn.groupBy("shard", "number").agg(F.count("*").alias("n")), "mix-draws")
    got = {r["number"]: r["n"] for r in counts.groupBy("number").agg(F.sum("n").alias("n")).collect()}
    # Sources drawn too often give their surplus, numbered through, to those drawn too seldom, numbered the same way.
    over = under = 0
    told = []
    for i, r in enumerate(rows):
        have = got.get(i, 0)
        told.append((i, have, max(have - r["slots"], 0) and over, max(r["slots"] - have, 0) and under, max(r["slots"] - have, 0)))
        over, under = over + max(have - r["slots"], 0), under + max(r["slots"] - have, 0)
    told = spark.createDataFrame(told, "number int, have bigint, over bigint, under bigint, lack bigint")
    slot = Window.partitionBy("shard").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    numbered = _before(counts, "shard", "number", "n", SHARD_GROUP, "base").withColumn("at", F.coalesce(F.sum("n").over(slot), F.lit(0)))
    numbered = numbered.repartition(-(-total // TASK_SLOTS), "shard")
    each = numbered.select("shard", "number", "base", "at", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("j"))
    each = each.join(_few(told.drop("under", "lack"), n), "number").join(_few(sources.select("number", "slots"), n), "number")
    rank = permuted(F.col("base") + F.col("j"), F.col("have"), F.lit("rank"), F.lit(seed), F.col("number"))
    each = each.select("shard", (F.col("at") + F.col("j")).alias("slot"), "number", "slots", "over", rank.alias("rank"))
    mine = each.where("rank < slots").select("shard", "slot", "number", "rank")
    spare = each.where("rank >= slots").select("shard", "slot", (F.col("over") + F.col("rank") - F.col("slots")).alias("_gift"))
    need = told.where("lack > 0").select("number", "have", "under", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("lack") - 1)).alias("j"))
    need = need.select("number", (F.col("have") + F.col("j")).alias("rank"), (F.col("under") + F.col("j")).alias("_gift"))
    every = mine.unionByName(spare.join(_merged(need), "_gift").select("shard", "slot", "number", "rank"))
    every = every.join(_few(sources, n), "number")
    lap, place = F.floor(F.col("rank") / F.col("blocks")), F.col("rank") % F.col("blocks")
    # The last, shorter block of a source ends each pass; whole blocks are permuted.
    index = F.when(place < F.col("whole"), permuted(place, F.col("whole"), F.lit("block"), F.lit(seed), F.col("number"), lap)).otherwise(place)
    length = F.when(place < F.col("whole"), F.lit(block)).otherwise(F.col("source_size") - F.col("whole") * block)
    words = F.least(length, F.col("wanted") - lap * F.col("source_size") - place * block)
    last = F.lit(total - 1) / shard_slots
    size = F.when(F.col("shard") == F.floor(last), F.lit((total - 1) % shard_slots + 1)).otherwise(F.lit(shard_slots))
    return every.select("shard", permuted(F.col("slot"), size, F.lit("slot"), F.lit(seed), F.col("shard")).alias("slot"), "number", index.cast("bigint").alias("block"), words.cast("bigint").alias("words"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = WEIGHTS, share: float = 1.5, most: float = 2.0,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 12,
) -> Mix:
    """Draw the mix; ``mixed_words`` turns its spans into words."""
    spark = docs.sparkSession
    sizes = common.pick(docs, doc_id=id_col, text=text_col, source=source_col)
    sizes = sizes.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("bigint").alias("size"))
    sizes = common.cut(sizes, "mix-sizes")
    found = [(r["source"], r["n"]) for r in sizes.groupBy("source").agg(F.sum("size").alias("n")).collect()]
    found.sort(key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    rows = []
    for (name, n), target in zip(found, targets([n for _, n in found], weights, share, most), strict=True):
        wanted = min(round(target), int(most * n))
        blocks, whole = -(-n // block_words), n // block_words
        laps, rest = divmod(wanted, n) if n else (0, 0)
        rows.append({"source": name, "source_size": n, "target": target, "wanted": wanted, "blocks": blocks, "whole": whole, "slots": laps * blocks - (-rest // block_words)})
    for r, (stay, other) in zip(rows, _alias([r["slots"] for r in rows]), strict=True):
        r["stay"], r["else"] = stay, other
    names = "source string, number int, source_size bigint, target double, wanted bigint, blocks bigint, whole bigint, slots bigint"
    sources = spark.createDataFrame([(r["source"], i, r["source_size"], r["target"], r["wanted"], r["blocks"], r["whole"], r["slots"]) for i, r in enumerate(rows)], names)
    named = _few(sources.select(F.col("source").alias("_name"), "number", "source_size", "target"), len(rows))
    located = _located(sizes.join(named, F.col("source").eqNullSafe(F.col("_name"))).drop("_name"))
    common.drop(sizes)
    slots = _slots(spark, rows, sources.drop("source", "target", "slots").join(sources.select("number", "slots"), "number"), block_words, shard_slots, seed)
    b = F.lit(block_words)
    held = located.where("size > 0").select("number", "first", (F.col("first") + F.col("size")).alias("_end"))
    pieces = held.select("*", F.explode(F.sequence(F.floor(F.col("first") / b), F.floor((F.col("_end") - 1) / b))).alias("block"))
    start = F.greatest("first", F.col("block") * b)
    pieces = pieces.select("number", "block", "first", (start - F.col("first")).alias("first_word"), (start - F.col("block") * b).alias("_from"), (F.least("_end", (F.col("block") + 1) * b) - F.col("block") * b).alias("_to"))
    spans = slots.join(_merged(pieces), ["number", "block"]).where("_from < words")
    return Mix(located, spans.select("shard", "slot", "number", "first", "first_word", (F.least("_to", "words") - F.col("_from")).alias("n_words")))


def mixed_words(mix: Mix, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """shard, slot, doc_id and the words (joined by one space) of every span, for documents with unique ids."""
    words = F.filter(F.split(F.col("text").cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    texts = common.pick(docs, doc_id=id_col, text=text_col).select("doc_id", words.alias("_words"))
    at = mix.spans.join(_merged(mix.documents.where("size > 0").select("number", "first", "doc_id")), ["number", "first"])
    return at.join(_merged(texts), "doc_id").select("shard", "slot", "doc_id", "first_word", F.array_join(F.slice("_words", F.col("first_word").cast("int") + 1, F.col("n_words").cast("int")), " ").alias("words"))


def op12_mixed_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mix_sources(common.table(spark, sf_dir, "documents"))
    taken = mix.spans.groupBy("number", "first").agg(F.sum("n_words").alias("_taken"))
    # Documents with words start at different words of their source; those without share a start with the next and take nothing.
    taken = taken.withColumn("_some", F.lit(True))
    docs = mix.documents.withColumn("_some", F.col("size") > 0)
    out = docs.join(_merged(taken), ["number", "first", "_some"], "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"))
