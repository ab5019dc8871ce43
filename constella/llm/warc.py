"""Content-addressed web archive: payload bytes stored once by SHA-256, exact record headers beside them.

``archive`` writes two tables to the shared folder: ``payloads`` (digest, payload), bucketed by digest
with one row for each distinct payload, and ``headers`` (one exact WARC header for each page, with the digest it
points to). ``reconstruct`` joins them again into the records as they are in a WARC file, ``original_payloads`` into every page's
payload, revisits included; ``read_back`` checks every stored payload against its digest and parses
the reconstructed records. ``export_warc`` writes plain WARC files from the same tables. Record ids are made from the page id and a
number of the row, so they differ even where page ids don't.

Defined results: a null payload counts as empty; a null URL leaves the target line out; a null id is kept
and comes after all others when the response is chosen; rows that repeat an id and its payload are all responses when that
id is the smallest. An empty table gives an empty table. Extra columns are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from constella.llm import common

#: The alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"


def base32_of_hex(digest: Column, n_bits: int) -> Column:
    """Upper-case base32 without padding of a hexadecimal text whose bits are a multiple of 40."""
    parts = []
    for at in range(0, n_bits // 4, 10):
        piece = F.conv(F.substring(digest, at + 1, 10), 16, 10).cast("bigint")
        for shift in range(35, -1, -5):
            parts.append(F.substring(F.lit(BASE32), (F.shiftright(piece, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)))
    return F.concat(*parts)


def sha1_base32(data: Column) -> Column:
    return base32_of_hex(F.sha1(data), 160)


@dataclass
class Archive:
    headers: DataFrame
    payloads: DataFrame
    table_name: str
    path: str

    def delete(self) -> None:
        spark = self.headers.sparkSession
        spark.sql(f"DROP TABLE IF EXISTS {self.table_name}")
        common.drop_path(spark, self.path)


def _urn(record: Column) -> Column:
    """A record id in the form of a UUID from the digest of what names the record."""
    h = F.md5(record.cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


#: Fixed value: SHA-256 of nothing, the block of a revisit.
NOTHING = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def _header(kind: Column, name: Column, url: Column, sha1: Column, sha256: Column, size: Column, first: Column, date: str) -> Column:
    """The WARC header text of a record, its closing empty line included. A revisit has an empty block and its payload's digest."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    response = kind == "response"
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", _urn(name)),
        F.when(url.isNotNull(), line("WARC-Target-URI", F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))).otherwise(F.lit("")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), sha1)),
        line("WARC-Block-Digest", F.concat(F.lit("sha256:"), F.when(response, sha256).otherwise(F.lit(NOTHING)))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Refers-To", _urn(first)), line("WARC-Profile", F.lit("identical-payload-digest")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(response, size).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )


def archive(df: DataFrame, id_col: str, url_col: str, payload_col: str, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write the archive of ``df`` and return its two tables as they are read from the shared folder.

    Only digests travel to find the first record of each payload; the payloads of those first records are then
    dealt once, by digest, into the buckets of the store.
    """
    spark = df.sparkSession
    pages = common.pick(df, id=id_col, url=url_col, payload=payload_col).withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    pages = pages.withColumn("digest", F.sha2("payload", 256))
    path = common.new_path(spark, "warc")
    name = F.concat_ws(":", F.coalesce(F.col("id").cast("string"), F.lit("none")), F.monotonically_increasing_id().cast("string"))
    facts = common.cut(pages.select("id", "url", "digest", sha1_base32(F.col("payload")).alias("sha1"), F.length("payload").alias("size"), name.alias("name")), "warc-facts")
    # Null ids come after all others.
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "name"))
    first = facts.groupBy("digest").agg(least.alias("f")).select("digest", F.col("f.id").alias("first"), F.col("f.name").alias("first_name"))
    kind = F.when(F.col("id").eqNullSafe(F.col("first")), F.lit("response")).otherwise(F.lit("revisit"))
    headers = facts.join(first, "digest").select(
        "id",
        "digest",
        "first",
        kind.alias("record_type"),
        _header(kind, F.col("name"), F.col("url"), F.col("sha1"), F.col("digest"), F.col("size"), F.col("first_name"), date).alias("header"),
    )
    headers.write.option("compression", "zstd").parquet(f"{path}/headers")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"payloads_{uuid.uuid4().hex}"
    # The aggregation deals payloads by digest into as many parts as there are buckets: each bucket is whole in a task.
    once = pages.groupBy("digest").agg(F.first("payload").alias("payload"))
    try:
        once.write.option("compression", "zstd").option("path", f"{path}/payloads").bucketBy(buckets, "digest").sortBy("digest").saveAsTable(table)
    except BaseException:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        raise
    common.drop(facts)
    return Archive(spark.read.schema(headers.schema).parquet(f"{path}/headers"), spark.table(table), table, path)


def reconstruct(stored: Archive) -> DataFrame:
    """Records as a WARC file has them: id, digest, record_type, header, and record = header, block and two line ends, as bytes."""
    tail = F.lit((CRLF + CRLF).encode())
    columns = ["id", "digest", "record_type", "header"]
    responses = stored.headers.where(F.col("record_type") == "response").join(stored.payloads, "digest")
    responses = responses.select(*columns, F.concat(F.encode("header", "UTF-8"), F.col("payload"), tail).alias("record"))
    revisits = stored.headers.where(F.col("record_type") == "revisit").select(*columns, F.concat(F.encode("header", "UTF-8"), tail).alias("record"))
    return responses.unionByName(revisits)


def original_payloads(stored: Archive) -> DataFrame:
    """id, record_type and payload of every archived page, revisits included."""
    return stored.headers.join(stored.payloads, "digest").select("id", "record_type", "payload")


def _field(header: Column, name: str) -> Column:
    """Value of a header line. Lines end at line feeds only: U+0085, U+2028 and U+2029 may stand within a URL."""
    return F.regexp_extract(header, rf"(?md)^{name}: ([^\r\n]*)\r?$", 1)


def parse(records: DataFrame) -> DataFrame:
    """Payload of each reconstructed record as its own header delimits it, checked against both digests there."""
    size = _field(F.col("header"), "Content-Length").cast("bigint")
    start = F.octet_length("header") + 1
    body = F.col("record").substr(start.cast("int"), size.cast("int"))
    parsed = records.select("id", "digest", "header", body.alias("payload"))
    sha1 = sha1_base32(F.col("payload"))
    good = (F.sha2("payload", 256) == F.col("digest")) & (F.concat(F.lit("sha1:"), sha1) == _field(F.col("header"), "WARC-Payload-Digest"))
    checked = F.when(good, F.length("payload").cast("bigint")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("bigint"))
    return parsed.select("id", "digest", checked.alias("payload_bytes"), sha1.alias("payload_digest"), "payload")


def read_back(stored: Archive) -> DataFrame:
    """One row for each archived page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Payloads are read and verified once each; revisits take the verified figures of the payload they refer to by
    a join of narrow rows, which Spark may split where one payload has very many revisits.
    """
    parsed = parse(reconstruct(stored).where("record_type = 'response'")).groupBy("digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("payload_digest").alias("payload_digest"))
    verified = common.cut(parsed, "warc-verified")
    revisit = F.col("record_type") == "revisit"
    return stored.headers.select("id", "digest", "record_type", "first").join(verified, "digest").select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(revisit, F.col("first")).alias("refers_to")
    )


def export_warc(stored: Archive, path: str) -> None:
    """Plain WARC files: every record followed by two line ends, which the text writer sets as its separator."""
    responses = stored.headers.where(F.col("record_type") == "response").join(stored.payloads, "digest")
    full = responses.select(F.concat("header", F.col("payload").cast("string")).alias("value"))
    short = stored.headers.where(F.col("record_type") == "revisit").select(F.col("header").alias("value"))
    full.unionByName(short).write.option("lineSep", CRLF + CRLF).text(path)


def op2_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = archive(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    try:
        return common.cut(read_back(stored), "warc-read")
    finally:
        stored.delete()


OP2_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
d AS (
  SELECT p.page_id, f.first_id, strlen(p.html) AS payload_bytes,
    list_transform([0, 1, 2, 3], lambda x: CAST('0x' || substr(p.h, x * 10 + 1, 10) AS BIGINT)) AS q
  FROM p JOIN f ON p.html = f.html
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((q[i // 8 + 1] >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d
"""
