"""Content-addressed WARC archive.

A payload's bytes are stored once, under its SHA-256, which is computed again and verified on reading; record
headers are stored apart, byte for byte. Joining the two by digest gives back the exact records.
Expressed as DataFrame functions throughout, so no task holds more than a row of its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

CRLF = "\r\n"
#: Payloads of fewer bytes are always stored as responses.
REVISIT_FROM = 100
#: The date of records whose rows have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    """payloads(payload_digest, payload): each content once. records(header, payload_digest, full): full if the block is the payload."""

    payloads: DataFrame
    records: DataFrame


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


def _safe(value: Column) -> Column:
    """Header values hold no line breaks: percent-encoded, as in URLs."""
    return F.replace(F.replace(F.replace(value, F.lit("%0"), F.lit("%250")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _header(page_id: Column, row: Column, url: Column, digest: Column, size: Column, first: Column, date: str) -> Column:
    """A record's header with the empty line that ends it. A revisit's block is empty. first(page_id, row): what it revisits, else null."""
    revisit = first.isNotNull()
    number = lambda x: F.coalesce(x.cast("string"), F.lit("none"))
    # the row's number tells records of one page apart
    urn = lambda page, row: F.concat(F.lit("<urn:page:"), number(page), F.lit(":"), row.cast("string"), F.lit(">"))
    return F.concat(
        F.lit("WARC/1.1" + CRLF),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", urn(page_id, row)),
        _line("WARC-Date", F.lit(date)),
        F.when(url.isNotNull(), _line("WARC-Target-URI", _safe(url))).otherwise(F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), digest)),
        F.when(revisit, F.concat(_line("WARC-Refers-To", urn(first["page_id"], first["row"])), _line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        _line("WARC-Payload-Length", number(size)),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit("0")).otherwise(number(size))),
        F.lit(CRLF),
    )


def write(ws: Workspace, pages: DataFrame, date: str = DATE) -> Archive:
    """Archive every row of pages(page_id, url, html); other columns are ignored.

    A null html is an empty payload; a null url gives a record without a target. Of rows with equal payloads of at
    least 100 bytes the one with the smallest page_id is the response (rows repeated under that page_id
    are responses too) and the others revisit it; null page_ids are always responses. Very long payloads are stored whole. Empty: no records.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    size = F.octet_length("payload").cast("long").alias("payload_bytes")
    read = pages.select("page_id", "url", payload.alias("payload")).withColumn("payload_digest", F.sha2("payload", 256))
    heads = ws.save(read.select("page_id", "url", "payload_digest", size, F.monotonically_increasing_id().alias("row")), "heads")
    # copies combine before they are shuffled, so each task sends a content once
    payloads = ws.save(read.groupBy("payload_digest").agg(F.any_value("payload").alias("payload")), "payloads")
    firsts = heads.filter("page_id IS NOT NULL").groupBy("payload_digest").agg(F.min(F.struct("page_id", "row")).alias("first"))
    revisits = (F.col("payload_bytes") >= REVISIT_FROM) & (F.col("page_id") > F.col("first.page_id"))
    told = heads.join(firsts, "payload_digest", "left").withColumn("first", F.when(revisits, F.col("first")))
    header = _header(*map(F.col, ("page_id", "row", "url", "payload_digest", "payload_bytes", "first")), date)
    records = ws.save(told.select(F.encode(header, "UTF-8").alias("header"), "payload_digest", F.col("first").isNull().alias("full")), "records")
    ws.drop(heads)
    return Archive(payloads, records)


def verified(archive: Archive) -> DataFrame:
    """The stored payloads; the query fails on one whose bytes do not have their digest."""
    ok = F.sha2("payload", 256) == F.col("payload_digest")
    return archive.payloads.select("payload_digest", F.when(ok, F.col("payload")).otherwise(F.raise_error("a stored payload does not have its digest").cast("binary")).alias("payload"))


def restore(archive: Archive) -> DataFrame:
    """The archived records, byte for byte: record (header and block, without the two line ends that follow in a file),
    and for revisits payload_bytes of what they refer to."""
    told = archive.records.join(verified(archive), "payload_digest")
    block = F.when(F.col("full"), F.col("payload")).otherwise(F.lit(b""))
    return told.select(F.concat("header", block).alias("record"), F.octet_length("payload").cast("long").alias("payload_bytes"))


def parse(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to and url, read from the bytes in `record`.

    A response's length and digest are computed from its block; a revisit's come from its header.
    """
    text = F.decode("record", "UTF-8")
    end = F.locate(CRLF + CRLF, text)
    a = records.withColumn("_head", F.substring(text, F.lit(1), end + 1))
    field = lambda name, what="[^\r]*": F.regexp_extract("_head", f"\r\n{name}: ({what})\r\n", 1)
    urn = lambda name: F.regexp_extract("_head", f"\r\n{name}: <urn:page:(-?[0-9]+):[0-9]+>", 1)
    number = lambda x: F.when(x != "", x).cast("long")
    a = a.withColumn("_block", F.substring("record", F.octet_length(F.encode("_head", "UTF-8")) + 3, F.octet_length("record")))
    response = field("WARC-Type") == "response"
    url = F.when(F.contains("_head", F.lit("\r\nWARC-Target-URI: ")), field("WARC-Target-URI"))
    return a.select(
        number(urn("WARC-Record-ID")).alias("page_id"),
        F.when(response, F.octet_length("_block").cast("long")).otherwise(number(field("WARC-Payload-Length"))).alias("payload_bytes"),
        F.when(response, F.sha2("_block", 256)).otherwise(field("WARC-Payload-Digest").substr(8, 64)).alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        number(urn("WARC-Refers-To")).alias("refers_to"),
        F.replace(F.replace(F.replace(url, F.lit("%0A"), F.lit("\n")), F.lit("%0D"), F.lit("\r")), F.lit("%250"), F.lit("%0")).alias("url"),
    )


def export(archive: Archive, path: str) -> None:
    """Write the records as WARC files (not compressed): each is its bytes and two line ends. Payloads are UTF-8."""
    restore(archive).select(F.decode("record", "UTF-8")).write.option("lineSep", CRLF + CRLF).option("compression", "none").text(path)
