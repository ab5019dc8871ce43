"""Secret scan with column expressions only: fixed patterns, and a battery of randomness tests.

Base spans come from three patterns. The battery adds spans of kind ``random``: runs of at least 20 characters of
``[A-Za-z0-9+/_=-]`` with a letter and a digit, outside every base span, whose symbols pass for random in
the encoding inferred for them. For each run three tests give p-values under uniform random symbols: chi-squared
of eight parts of the alphabet (with the number of symbols that each part has), the runs test about the alphabet's middle, and the
lag-one serial correlation. Fisher's method joins them, with Brown's correction since the last two say much the same. Runs of fewer than 16 symbols of their alphabet (the rest are signs of equality) have
p = 0. Within each class of lengths the number of runs that are random is estimated from the upper half of the p-values, where words and
identifiers hardly occur and random runs fill all parts alike: a part that holds fewer than chance allows lowers the estimate. The lowest
p-value threshold is kept at which the estimated share of false discoveries (runs kept that are no random text) is at most ``rate``; a class
without such a threshold gives no spans.

Defined results: null and empty texts have no spans; repeated rows give equal rows; an empty table gives an
empty one; extra columns are left out. Positions are code points, ends exclusive. ``password`` and its like match in either case of A-Z.
Positions, overlaps and replacements are found by blocks of matches or of text, so that work hardly grows faster than the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: The base patterns, in the order in which kinds are listed, with the length that a match needs.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: A run of the last two patterns that is too short fails whatever starts inside it, so the length can be part of the pattern.
ACCESS_LONG = r"AKIA[A-Z0-9]{16,}"
HEX_LONG = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
RUN = r"[A-Za-z0-9+/_=-]{20,}"
#: Length classes of runs start at these lengths.
CLASSES = (20, 28, 36, 48, 64, 128)
P_BINS = 64
#: Degrees of freedom of Fisher's sum with Brown's correction: six for three independent tests, fewer since the runs test and the serial
#: correlation of uniform numbers are correlated by 0.75 (covariance of their logarithms 2.218).
FREEDOM = 2 * 6**2 / (12 + 2 * 2.218)
#: Matches of a block of running sums, code points of a block of text.
SUM_BLOCK, TEXT_BLOCK = 64, 4096
_SPAN = "array<struct<start:int,end:int,kind:int>>"

_DIGITS, _UPPER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_ALPHABETS = {
    "hex": ("^[0-9a-f]+$", _DIGITS + "abcdef"),
    "HEX": ("^[0-9A-F]+$", _DIGITS + "ABCDEF"),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567"),
    "base36": ("^[0-9a-z]+$", _DIGITS + _UPPER.lower()),
    "base62": ("^[0-9A-Za-z]+$", _DIGITS + _UPPER + _UPPER.lower()),
    "base64": ("", _UPPER + _UPPER.lower() + _DIGITS + "+/"),
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def _block(values: Column, number: Column, size: int = SUM_BLOCK) -> Column:
    return F.slice(values, number * size + 1, F.lit(size))


def _running(values: Column) -> Column:
    """Running sums of an array of whole numbers, by blocks."""

    def within(blocks: Column, before: Column) -> Column:
        return F.flatten(
            F.transform(blocks, lambda b: _let(_block(values, b), lambda own: F.transform(own, lambda _, i: F.element_at(before, b + 1) + _total(F.slice(own, 1, i + 1)))))
        )

    def sums(blocks: Column) -> Column:
        return _let(F.transform(blocks, lambda b: _total(_block(values, b))), lambda each: _let(F.transform(blocks, lambda b: _total(F.slice(each, 1, b))), lambda before: within(blocks, before)))

    last = ((F.size(values) - 1) / SUM_BLOCK).cast("int")
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(_let(F.sequence(F.lit(0), last), sums))


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, end, kind, value) of the leftmost non-overlapping matches; pieces between them give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = [found.alias("m"), F.split(text, pattern, -1).alias("between")]
    if keep is not None:
        parts.append(F.regexp_extract_all(text, F.lit(pattern), F.lit(keep[0])).alias("g"))
    empty = "array<struct<start:int,end:int,kind:int,value:string>>"

    def places(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["between"], 1, F.size(x["m"])), x["m"], lambda a, b: F.coalesce(F.char_length(a), F.lit(0)) + F.char_length(b))
        made = lambda end, m: F.struct((end - F.char_length(m)).alias("start"), end.alias("end"), F.lit(kind).alias("kind"), m.alias("value"))
        rows = F.zip_with(_let(sizes, _running), x["m"], made)
        if keep is None:
            return rows
        return F.filter(F.zip_with(rows, x["g"], lambda r, g: F.when(F.char_length(g) >= keep[1], r)), lambda r: r.isNotNull())

    return F.when(text.rlike(pattern), _let(F.struct(*parts), places).cast(empty)).otherwise(F.array().cast(empty))


def _blocks(spans: Column) -> Column:
    """Spans in blocks, so that none of them is looked up in all."""
    last = ((F.size(spans) - 1) / SUM_BLOCK).cast("int")
    return F.when(F.size(spans) == 0, F.array().cast(f"array<{_SPAN}>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda b: _block(spans, b)))


def _apart(blocks: Column, run: Column) -> Column:
    """Whether a run meets none of some spans that are in order and don't overlap.

    The last span that starts before the run's end reaches furthest, and it is in the last block that does.
    """
    block = F.size(F.filter(blocks, lambda b: F.element_at(b, 1)["start"] < run["end"]))
    meets = lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"])
    return _let(block, lambda at: F.when(at == 0, F.lit(True)).otherwise(~F.exists(F.element_at(blocks, F.greatest(at, F.lit(1))), meets)))


# --- the battery -------------------------------------------------------------------------------


def normal_tail(z: Column) -> Column:
    """P(N > z) for z >= 0 by a rational approximation with an error below 1e-7 (Abramowitz and Stegun 26.2.17)."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.2316419) * z)
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = (poly + F.lit(c)) * t
    return F.exp(-z * z / 2.0) * F.lit(0.3989422804014327) * poly


def two_sided(z: Column) -> Column:
    return _let(F.least(F.abs(z), F.lit(30.0)), lambda x: F.least(F.lit(1.0), F.lit(2.0) * normal_tail(x)))


def _part(index: int, size: int) -> int:
    """Which eighth of an alphabet its symbol number ``index`` (from 1) is in."""
    return int((index - 0.5) * 8 / size)


def _alphabet(name: str) -> Column:
    """Symbols of an encoding, their number, and how much of it each eighth has."""
    symbols = _ALPHABETS[name][1]
    k = len(symbols)
    shares = [sum(_part(i, k) == b for i in range(1, k + 1)) / k for b in range(8)]
    return F.struct(F.lit(symbols).alias("symbols"), F.lit(float(k)).alias("k"), F.array(*[F.lit(x) for x in shares]).alias("shares"))


def _p_value(value: Column) -> Column:
    """Joint p of a run's symbols under uniform random symbols of the inferred encoding."""
    plain = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")

    def inferred(x: Column) -> Column:
        out = _alphabet("base64")
        for name in ("base62", "base36", "base32", "HEX", "hex"):
            out = F.when(x.rlike(_ALPHABETS[name][0]), _alphabet(name)).otherwise(out)
        return out

    def index(x: Column, a: Column) -> Column:
        # Symbols one by one, without looking for each from the start of the run.
        return F.filter(F.transform(F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0)), lambda c: F.instr(a["symbols"], c)), lambda i: i > 0)

    def battery(u: Column, a: Column) -> Column:
        n = F.size(u).cast("double")
        eighth = F.transform(u, lambda v: F.floor(v * 8))
        counted = lambda e: F.transform(a["shares"], lambda share, b: F.pow(F.size(F.filter(e, lambda v: v == b)).cast("double"), F.lit(2.0)) / share)
        chi2 = _let(eighth, lambda e: F.aggregate(counted(e), F.lit(0.0), lambda s, c: s + c)) / n - n
        wilson = (F.cbrt(F.greatest(chi2, F.lit(0.0)) / 7.0) - (1 - 2 / 63)) / (2 / 63) ** 0.5
        p_chi = _let(wilson, lambda w: F.when(w >= 0, normal_tail(F.least(w, F.lit(30.0)))).otherwise(1.0 - normal_tail(F.least(-w, F.lit(30.0)))))
        signs = F.transform(u, lambda v: F.when(v < 0.5, F.lit(0)).otherwise(F.lit(1)))
        pairs = _let(signs, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda p, q: F.when(q.isNull(), 0).when(p == q, 0).otherwise(1)))
        runs = F.aggregate(pairs, F.lit(0), lambda p, q: p + q).cast("double")
        # A number of runs right in the middle counts half, as other numbers do by the normal curve.
        p_runs = two_sided((runs - (n - 1) / 2) / F.sqrt((n - 1) / 4)) - F.when(runs * 2 == n - 1, F.lit(0.3989422804014327) / F.sqrt(n - 1)).otherwise(0.0)
        centred = F.transform(u, lambda v: v - 0.5)
        products = _let(centred, lambda x: F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x)), lambda p, q: p * q))
        lag = F.aggregate(products, F.lit(0.0), lambda s, p: s + F.coalesce(p, F.lit(0.0)))
        p_lag = two_sided(lag * 12.0 / (1.0 - 1.0 / (a["k"] * a["k"])) / F.sqrt(n - 1))
        logs = [F.log(F.greatest(p, F.lit(1e-12))) for p in (p_chi, p_runs, p_lag)]
        # The sum over its mean is a chi-squared variable over its degrees of freedom, whose cube root is about normal.
        joined = (F.cbrt(-(logs[0] + logs[1] + logs[2]) / 3.0) - (1 - 2 / (9 * FREEDOM))) / (2 / (9 * FREEDOM)) ** 0.5
        return _let(joined, lambda z: F.when(z >= 0, normal_tail(F.least(z, F.lit(30.0)))).otherwise(1.0 - normal_tail(F.least(-z, F.lit(30.0)))))

    def tests(x: Column, a: Column) -> Column:
        places = _let(index(x, a), lambda i: F.transform(i, lambda v: (v.cast("double") - 0.5) / a["k"]))
        return _let(places, lambda u: F.when(F.size(u) < 16, F.lit(0.0)).otherwise(battery(u, a)))

    return _let(plain, lambda x: _let(inferred(x), lambda a: tests(x, a)))


def _length_class(n: Column) -> Column:
    out = F.lit(0)
    for i, start in enumerate(CLASSES):
        out = F.when(n >= start, F.lit(i)).otherwise(out)
    return out


def thresholds(runs: DataFrame, rate: float) -> DataFrame:
    """For each length class the lowest p that keeps the estimated false discoveries at ``rate``: at most six rows."""
    half, part = P_BINS // 2, P_BINS // 8
    counted = runs.groupBy("length_class", F.least(F.floor(F.col("p") * P_BINS), F.lit(P_BINS - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    parts = [F.sum(F.when(F.floor((F.col("bin") - half) / part) == j, F.col("n")).otherwise(0)).cast("double").alias(f"part{j}") for j in range(4)]
    classes = counted.groupBy("length_class").agg(*parts, F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("by_bin"))
    columns = [F.col(f"part{j}") for j in range(4)]
    upper = columns[0] + columns[1] + columns[2] + columns[3]
    # An eighth of the random runs, from the upper four: their mean, or what the emptiest of them allows. Two standard deviations are chance, and
    # tests of few symbols fill parts within a third alike.
    eighth = F.least((upper + 2.0 * F.sqrt(upper)) / 4, *[c * (4.0 / 3.0) + 2.0 * F.sqrt(c) + 1.0 for c in columns])
    grid = classes.select("length_class", upper.alias("upper"), eighth.alias("eighth"), "by_bin", F.explode(F.sequence(F.lit(0), F.lit(half))).alias("at"))
    kept = F.aggregate(
        F.filter(F.map_entries("by_bin"), lambda e: e["key"] >= F.col("at")), F.lit(0).cast("bigint"), lambda a, e: a + e["value"]
    )
    false_share = 1.0 - 8.0 * F.col("eighth") * (1.0 - F.col("at") / P_BINS) / F.greatest(kept, F.lit(1))
    usable = grid.where((F.col("upper") > 0) & (false_share <= rate))
    return usable.groupBy("length_class").agg((F.min("at") / P_BINS).alias("least_p"))


def _with_spans(df: DataFrame, text_col: str) -> DataFrame:
    """``df`` with ``__base``, the base spans, and ``__runs``, the runs outside them with their length class and p-value."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kinds = [_spans(text, ASSIGN, 0, (2, 6)), _spans(text, ACCESS_LONG, 1), _spans(text, HEX_LONG, 2)]
    found = df.select("*", *[F.transform(k, lambda s: s.dropFields("value")).cast(_SPAN).alias(f"__kind{i}") for i, k in enumerate(kinds)], _spans(text, RUN, 3).alias("__found"))

    def alone(blocks: Column) -> Column:
        return F.filter(
            F.filter(F.col("__found"), lambda r: r["value"].rlike("[0-9]") & r["value"].rlike("[A-Za-z]")),
            lambda r: _apart(blocks["b0"], r) & _apart(blocks["b1"], r) & _apart(blocks["b2"], r),
        )

    blocks = F.struct(*[_blocks(F.col(f"__kind{i}")).alias(f"b{i}") for i in range(3)])
    scored = F.transform(
        _let(blocks, alone),
        lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"), _length_class(r["end"] - r["start"]).alias("length_class"), F.round(_p_value(r["value"]), 9).alias("p")),
    )
    base = F.array_sort(F.concat("__kind0", "__kind1", "__kind2"))
    return found.select(*[F.col(c) for c in df.columns], base.alias("__base"), scored.alias("__runs"))


def _levels(runs: DataFrame, rate: float) -> Column:
    """The thresholds (at most six numbers) as a literal map from length class to least p."""
    rows = thresholds(runs.where(F.size("__runs") > 0).select(F.explode("__runs").alias("r")).select("r.*"), rate).collect()
    entries = [F.lit(v) for r in sorted(rows) for v in (r["length_class"], r["least_p"])]
    return F.create_map(*entries) if entries else F.create_map(F.lit(-1), F.lit(2.0))


def _kept(levels: Column) -> Column:
    kept = F.filter(F.col("__runs"), lambda r: r["p"] >= F.coalesce(F.element_at(levels, r["length_class"]), F.lit(2.0)))
    return F.transform(kept, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"), r["kind"].alias("kind"))).cast(_SPAN)


def scan_secrets(df: DataFrame, id_col: str, text_col: str, rate: float = 0.1) -> DataFrame:
    """One row for each text: doc_id, base (base spans), extra (spans that the battery adds), spans (both, in order)."""
    source = common.pick(df, doc_id=id_col, text=text_col)
    written = common.cut(_with_spans(source, "text").select("doc_id", "__base", "__runs"), "secrets")
    found = written.select("doc_id", F.col("__base").alias("base"), _kept(_levels(written, rate)).alias("extra"))
    return found.withColumn("spans", F.array_sort(F.concat("base", "extra")))


def redact_secrets(df: DataFrame, text_col: str, rate: float = 0.1, mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of ``text_col`` replaced by ``mark``; a null text stays null.

    The texts are read twice, for the thresholds and for the spans, so that they need no join.
    """
    levels = _levels(_with_spans(df.select(F.col(text_col)), text_col), rate)
    found = _with_spans(df, text_col).withColumn("__spans", F.concat(F.col("__base"), _kept(levels)))
    return found.withColumn(text_col, redact(F.col(text_col), F.col("__spans"), mark)).select(df.columns)


def span_text(spans: Column) -> Column:
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(ordered, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """Text with every span replaced by ``mark``; spans that overlap are merged first."""
    pair = "struct<start:int,end:int>"

    def merge(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end")).cast(pair)
        fresh = F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")).cast(pair)))
        return F.when(F.size(out) == 0, fresh).when(s["start"] < last["end"], F.concat(F.slice(out, 1, F.size(out) - 1), F.array(wider))).otherwise(fresh)

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        """Code points from ``start`` to ``end``, from the blocks that hold them."""
        first, last = (start / TEXT_BLOCK).cast("int"), ((end - 1) / TEXT_BLOCK).cast("int")
        head = F.substring(F.element_at(blocks, first + 1), start % TEXT_BLOCK + 1, F.lit(TEXT_BLOCK))
        tail = F.substring(F.element_at(blocks, last + 1), F.lit(1), (end - 1) % TEXT_BLOCK + 1)
        inside = F.substring(F.element_at(blocks, first + 1), start % TEXT_BLOCK + 1, end - start)
        whole = F.concat(head, F.array_join(F.slice(blocks, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), tail)
        return F.when(end <= start, F.lit("")).when(first == last, inside).otherwise(whole)

    def joined(merged: Column, blocks: Column) -> Column:
        number = F.size(merged)
        start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.element_at(merged, F.greatest(i, F.lit(1)))["end"])
        end = lambda i: F.when(i == number, F.char_length(text)).otherwise(F.element_at(merged, F.least(i + 1, number))["start"])
        return F.array_join(F.transform(F.sequence(F.lit(0), number), lambda i: piece(blocks, start(i), end(i))), mark)

    merged = F.aggregate(F.array_sort(spans), F.array().cast(f"array<{pair}>"), merge)
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))
    return F.when(F.size(spans) > 0, _let(merged, lambda m: _let(blocks, lambda b: joined(m, b)))).otherwise(text)


def base_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base spans alone, which SQL can express too."""
    return op3_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def _spans_sql(name: str, kind: int, pattern: str, group: int, least: int) -> str:
    """Places of a pattern's matches: the matches, the pieces between them, and running sums of their lengths."""
    quoted = pattern.replace("'", "''")
    return f"""{name}0 AS (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {group}) AS g, string_split_regex(t, '{quoted}') AS b FROM d WHERE regexp_matches(t, '{quoted}')),
  {name}1 AS (SELECT doc_id, generate_subscripts(m, 1) AS i, unnest(m) AS m, unnest(g) AS g, unnest(b[1:len(m)]) AS b FROM {name}0),
  {name} AS (SELECT doc_id, {kind} AS kind, e - length(m) AS s, e FROM (SELECT *, sum(length(b) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS e FROM {name}1) WHERE length(g) >= {least})"""


BASE_SQL = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
  {_spans_sql('a', 0, ASSIGN, 2, 6)},
  {_spans_sql('k', 1, ACCESS, 0, 20)},
  {_spans_sql('h', 2, HEX_LONG, 0, 24)},
  every AS (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h),
  joined AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, kind) AS spans FROM every GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256
FROM d LEFT JOIN joined USING (doc_id)"""


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
    )
