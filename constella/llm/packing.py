"""Packing into length buckets: boundaries that minimise padding, and batches under a token budget inside each.

The length of a text is its number of words (maximal runs of characters that are not white space) and one end mark. A dynamic
programme over the histogram of all lengths chooses ``n_buckets`` upper boundaries so that the padding, the sum over all texts of
boundary minus length, is least. Inside a bucket texts are numbered and every ``budget // boundary`` of them (one at
least) form a batch. The driver has one row for each length that occurs: their number is at most the root of twice the words of the corpus.

Defined results: null and empty texts have length 1. Rows that repeat an id are packed separately. An empty table gives an
empty table. Null ids are packed like any other. Extra columns are left out. No text is cut, dropped or split.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from constella.llm import common

#: Rows of a bucket that one task numbers, about.
SLICE_ROWS = 20000


def word_count(text: Column) -> Column:
    """Words between white space, without building them: white space before a non-space, found by deleting the rest."""
    squeezed = F.regexp_replace(F.trim(F.translate(F.coalesce(text.cast("string"), F.lit("")), "\t\n\x0b\x0c\r", "     ")), " +", " ")
    gaps = F.char_length(squeezed) - F.char_length(F.translate(squeezed, " ", ""))
    return F.when(squeezed == "", F.lit(0)).otherwise(gaps + 1).cast("bigint")


def best_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Upper boundaries of at most ``n_buckets`` runs of the ascending ``lengths`` with the least padding.

    Divide and conquer over the cut points: the best cut moves up with the end, so a layer takes n log n steps. All ends of one depth are
    worked out together.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = np.asarray(lengths, np.float64), np.asarray(counts, np.float64)
    rows, mass = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)])
    best = np.full(n + 1, np.inf)
    best[0] = 0
    cuts = []
    for _ in range(min(n_buckets, n)):
        following, cut = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        following[0] = 0
        lo, hi, first, last = (np.array([x], np.int64) for x in (1, n, 0, n - 1))
        while len(lo):
            j = (lo + hi) // 2
            size = np.minimum(last, j - 1) - first + 1
            start = np.cumsum(size) - size
            i = np.arange(int(size.sum())) - np.repeat(start - first, size)
            end = np.repeat(j, size)
            cost = best[i] + lengths[end - 1] * (rows[end] - rows[i]) - (mass[end] - mass[i])
            least = np.minimum.reduceat(cost, start)
            # The first cut of each end that has the least cost.
            at = np.flatnonzero(cost == np.repeat(least, size))
            k = i[at[np.searchsorted(at, start)]]
            following[j], cut[j] = least, k
            lo, hi, first, last = np.concatenate([lo, j + 1]), np.concatenate([j - 1, hi]), np.concatenate([first, k]), np.concatenate([k, last])
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        best = following
        cuts.append(cut)
    out, j = [], n
    for cut in reversed(cuts):
        if j > 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(df: DataFrame, id_col: str, text_col: str, n_buckets: int = 16, budget: int = 16384, length_col: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, padded_length, batch (from 0 in each bucket), slot (place in the batch) for each row.

    ``length_col`` names a column with lengths that are known already, such as numbers of token ids; nulls there count as 1.
    """
    length = word_count(F.col("text")) + 1 if length_col is None else F.greatest(F.coalesce(F.col("length").cast("bigint"), F.lit(1)), F.lit(1)).cast("bigint")
    columns = common.pick(df, doc_id=id_col, **({"text": text_col} if length_col is None else {"length": length_col}))
    lengths = common.cut(columns.select("doc_id", length.alias("n_tokens"), F.monotonically_increasing_id().alias("row")), "lengths")
    histogram = lengths.groupBy("n_tokens").agg(F.count("*").alias("n")).toArrow()
    order = np.argsort(histogram["n_tokens"].to_numpy())
    bounds = best_boundaries(histogram["n_tokens"].to_numpy()[order], histogram["n"].to_numpy()[order], n_buckets)
    return batches(lengths, bounds, budget)


def batches(lengths: DataFrame, bounds: list[int], budget: int) -> DataFrame:
    """Number the rows of each bucket exactly, without bringing a bucket to one task.

    A bucket's rows are dealt to slices by a hash of the row; the sizes of the slices give each one's first number.
    """
    if not bounds:
        return lengths.select("doc_id", "n_tokens", *[F.lit(0).cast(t).alias(c) for c, t in (("bucket", "int"), ("padded_length", "bigint"), ("batch", "bigint"), ("slot", "int"))])
    bucket, padded = F.lit(len(bounds) - 1), F.lit(bounds[-1])
    for i in range(len(bounds) - 2, -1, -1):
        bucket = F.when(F.col("n_tokens") <= bounds[i], F.lit(i)).otherwise(bucket)
        padded = F.when(F.col("n_tokens") <= bounds[i], F.lit(bounds[i])).otherwise(padded)
    placed = lengths.select("doc_id", "n_tokens", "row", bucket.cast("int").alias("bucket"), padded.cast("bigint").alias("padded_length"))
    slices = max(1, lengths.count() // SLICE_ROWS)
    placed = placed.withColumn("slice", F.pmod(F.xxhash64("row"), F.lit(slices)).cast("int"))
    sizes = placed.groupBy("bucket", "slice").agg(F.count("*").alias("n"))
    first = sizes.select("bucket", "slice", (F.sum("n").over(Window.partitionBy("bucket").orderBy("slice")) - F.col("n")).alias("first"))
    within = F.row_number().over(Window.partitionBy("bucket", "slice").orderBy("doc_id", "n_tokens", "row")) - 1
    numbered = placed.withColumn("within", within).join(first, ["bucket", "slice"])
    per_batch = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("padded_length"))).cast("bigint")
    number = (F.col("within") + F.col("first")).cast("bigint")
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "padded_length", F.floor(number / per_batch).cast("bigint").alias("batch"), (number % per_batch).cast("int").alias("slot")
    )


def batch_table(packed: DataFrame) -> DataFrame:
    """One row for each batch: bucket, batch, padded_length, doc_ids in slot order, and its tokens with and without padding."""
    members = F.array_sort(F.collect_list(F.struct("slot", "doc_id")))
    out = packed.groupBy("bucket", "batch").agg(F.first("padded_length").alias("padded_length"), members.alias("m"), F.sum("n_tokens").alias("n_tokens"))
    return out.select("bucket", "batch", "padded_length", F.transform("m", lambda x: x["doc_id"]).alias("doc_ids"), "n_tokens", (F.size("m") * F.col("padded_length")).alias("padded_tokens"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), "doc_id", "text")
