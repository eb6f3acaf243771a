"""Content-addressed WARC archive: payload bytes once by verified strong digest, exact record headers apart.

Records are made from pages (page_id, url, html). Of records with one payload, that with the smallest page_id is the
response and the others are revisits that refer to it, provided the payload has at least `least_bytes` bytes. The archive
is two Parquet tables, which every Spark store can hold:

* payloads (sha256, sha1, n_bytes, payload): each distinct payload once; reading recomputes both digests and the length,
  and a row whose bytes do not match its digests raises.
* headers (page_id, sha256, record_type, refers_to, header): the header block of each record byte for byte.

`read_archive` joins the two and gives back whole records; columns that are not asked for are pruned.
`described` reads type, reference, length and digest from the bytes of whole records, so payloads go through the join.

Edge cases: null html is an empty payload (0 bytes); a null url gives an empty target; line ends within a url, which no header can hold,
are percent-encoded; repeated page_ids stay separate rows
(each row whose page_id is the smallest of its payload is a response); rows without a
page_id are archived with an empty id; other columns of the input are ignored; an empty table makes an empty
archive.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read

#: RFC 4648 alphabet, fixed.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Digits of conv(…, 16, 32), fixed.
CONV32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
CRLF = "\r\n"
#: Fixed by WARC/1.1 for revisits by identical payload digest.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_BYTES = 0


def base32_of_sha1(hex_digest: Column) -> Column:
    """Upper-case base32 of a 40-digit hex SHA-1: four groups of 40 bits, eight digits each."""
    groups = [F.lpad(F.conv(F.substring(hex_digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), CONV32, BASE32)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(page_id, sha256, sha1, n_bytes, record_type, refers_to, header) for each row of pages."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # digests are made once for each row, before rows are matched
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.sha2(payload, 256).alias("sha256"), F.sha1(payload).alias("sha1"), F.length(payload).cast("long").alias("n_bytes"))
    first = rows.groupBy("sha256").agg(F.min("page_id").alias("first_id"))
    rows = rows.join(first, "sha256")
    revisit = (F.col("n_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    rows = rows.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("first_id")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_sha1(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))), line("WARC-Profile", F.lit(REVISIT_PROFILE)))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
        F.lit(CRLF),
    )
    return rows.select("page_id", "sha256", "sha1", "n_bytes", "record_type", "refers_to", F.encode(header, "UTF-8").alias("header"))


def write_archive(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES) -> None:
    """Write headers and payloads.

    Payloads are grouped by digest with partial aggregation: of a payload with many copies one goes on from each map task, and one
    is stored.
    """
    scratch.save(records(pages, least_bytes).select("page_id", "sha256", "record_type", "refers_to", "header"), "headers")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    # first() of a digest's payloads after partial aggregation: one payload for each digest and map task
    distinct = pages.select(F.sha2(payload, 256).alias("sha256"), payload.alias("payload")).groupBy("sha256").agg(F.first("payload").alias("payload"))
    scratch.save(distinct.select("sha256", F.sha1("payload").alias("sha1"), F.length("payload").cast("long").alias("n_bytes"), "payload"), "payloads")


def read_archive(spark: SparkSession, headers_path: str, payloads_path: str) -> DataFrame:
    """Each record with its whole payload: page_id, record_type, refers_to, header, payload, n_bytes, sha1, record_bytes.

    The stored bytes are digested again; a mismatch raises. record_bytes is the record as a WARC file holds it: header,
    block (empty for revisits), two line ends.
    """
    stored = spark.read.parquet(payloads_path)
    bad = (F.sha2("payload", 256) != F.col("sha256")) | (F.sha1("payload") != F.col("sha1")) | (F.length("payload") != F.col("n_bytes"))
    checked = F.when(bad, F.raise_error(F.concat(F.lit("payload does not match digest "), F.col("sha256")))).otherwise(F.col("sha1"))
    stored = stored.select("sha256", checked.alias("sha1"), "n_bytes", "payload")
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.lit((CRLF * 2).encode())
    return spark.read.parquet(headers_path).join(stored, "sha256").select("page_id", "record_type", "refers_to", "header", "payload", "n_bytes", "sha1", F.concat("header", block, end).alias("record_bytes"))


def parse_records(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record of a WARC file, plain or in gzip members."""
    stream = io.BytesIO(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data)
    while header := stream.readline():
        if not header.strip():
            continue
        length = 0
        while line := stream.readline():
            header += line
            if line == b"\r\n":
                break
            if line.lower().startswith(b"content-length:"):
                length = int(line.split(b":", 1)[1])
        yield header, stream.read(length)
        stream.read(4)


def described(back: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the bytes of whole records say.

    The header block is what stands before the first empty line. A Content-Length other than the block's or a digest other than the
    payload's raises. A revisit's block is empty; its payload's length is that of the payload it refers to.
    """
    head = F.substring_index(F.col("record_bytes").cast("string"), CRLF * 2, 1)
    rows = back.select("page_id", "n_bytes", "sha1", F.length("record_bytes").alias("whole"), head.alias("head"))
    field = lambda name, value="([^\r]*)": F.regexp_extract("head", f"\r\n{name}: {value}", 1)
    kind, length, digest = field("WARC-Type"), field("Content-Length").cast("long"), field("WARC-Payload-Digest", "sha1:([^\r]*)")
    # two line ends after the header, two after the block
    right = length.eqNullSafe(F.col("whole") - F.octet_length("head") - 4 * len(CRLF)) & (digest == base32_of_sha1(F.col("sha1")))
    right &= (kind == "revisit") | (length == F.col("n_bytes"))
    wrong = F.raise_error(F.concat(F.lit("header does not match its record: "), F.col("head")))
    refers = F.nullif(field("WARC-Refers-To", "<urn:page:([^>]*)>"), F.lit("")).cast(back.schema["refers_to"].dataType)
    return rows.select(
        "page_id",
        F.when(kind == "revisit", F.col("n_bytes")).otherwise(length).alias("payload_bytes"),
        F.when(right, digest).otherwise(wrong).alias("payload_digest"),
        kind.alias("record_type"),
        refers.alias("refers_to"),
    )


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the archive of all pages, read it back, and report what the bytes of each record say."""
    scratch = Scratch(spark, "warc")
    write_archive(read(spark, sf_dir, "pages"), scratch)
    return described(read_archive(spark, scratch.path("headers"), scratch.path("payloads")))


def _sql() -> str:
    digits = " || ".join(f"substr('{BASE32}', 1 + cast((('0x' || substr(h, {1 + 10 * c}, 10))::BIGINT >> {35 - 5 * j}) & 31 AS INTEGER), 1)" for c in range(4) for j in range(8))
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {digits} AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d"""


SQL = _sql()
