"""WARC archives without repeated payloads: revisit records refer to one response of each payload digest.

Only headers are shuffled by digest; payloads stay where they are read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

DATE = "2025-01-01T00:00:00Z"
END = "\r\n\r\n"
#: Bytes of an archive, about: a task holds one whole when it reads.
ARCHIVE = 32 << 20


def digest32(payload: Column) -> Column:
    """Bare upper-case base32 of a payload's SHA-1: 20 bits, so 4 letters, at a time."""
    code = F.sha1(payload)
    digits = F.concat(*[F.lpad(F.conv(F.substring(code, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, least: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to, refers_to_url): one response for each payload of `least` bytes or more.

    Headers (digest, id, url) are shuffled by digest and pre-aggregated; of each digest that occurs twice the row with the
    largest page_id is the response. Payloads are not shuffled by digest: they learn their verdict where they lie from
    the list of repeated digests while that is within the broadcast bound, beyond it by a join on (page_id, digest),
    which no third of the rows shares. Null payloads are empty. A null page_id is the smallest. Repeated rows of the
    largest id are responses all.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).alias("page_id"), (F.col(url) if url in pages.columns else F.lit(None)).cast("string").alias("url"), body.alias("payload"), F.octet_length(body).cast("long").alias("payload_bytes"), digest32(body).alias("digest"))
    headers = rows.where(F.col("payload_bytes") >= least).select("page_id", "url", "digest")
    last = headers.groupBy("digest").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("count")).where("count > 1")
    last = C.materialise(last, "warc-repeated")
    n = last.count()
    if n <= C.BROADCAST_ROWS:
        rows = rows.join(F.broadcast(last.drop("count")), "digest", "left")
    else:
        held = C.materialise(headers.select("page_id", "digest").distinct(), "warc-ids")
        verdict = C.salted_join(held, last.drop("count"), ["digest"], last.select("digest", "count"), held.count(), ["page_id"])
        verdict = verdict.where(~F.col("page_id").eqNullSafe(F.col("last.page_id"))).select(F.col("page_id").alias("_p"), F.col("digest").alias("_d"), "last")
        rows = rows.join(verdict, F.col("page_id").eqNullSafe(F.col("_p")) & (F.col("digest") == F.col("_d")), "left")
    revisit = F.col("last").isNotNull() & (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("last.page_id")).alias("refers_to"), F.when(revisit, F.col("last.url")).alias("refers_to_url"))


def _record_id(page_id: Column, digest: Column) -> Column:
    h = F.sha2(F.concat_ws(":", F.coalesce(page_id.cast("string"), F.lit("")), digest), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _uri(url: str, page_id: str) -> Column:
    return F.regexp_replace(F.coalesce(url, F.concat(F.lit("urn:page:"), F.coalesce(F.col(page_id).cast("string"), F.lit("")))), r"[\x00-\x20\x7f]", "%20")


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One WARC/1.1 record a row, with fresh headers, without the empty line that ends it."""
    is_revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.when(is_revisit, http).otherwise(F.concat(http, F.col("payload")))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(F.col("page_id"), F.col("digest"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _uri("url", "page_id")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(is_revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(F.col("refers_to"), F.col("digest")))),
        F.when(is_revisit, F.concat(F.lit("WARC-Refers-To-Target-URI: "), _uri("refers_to_url", "refers_to"))),
        F.when(is_revisit, F.lit(f"WARC-Refers-To-Date: {date}")),
        F.concat(F.lit("X-Page-ID: "), F.col("page_id").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return resolved.select(F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block).alias("value"))


def _info(date: str) -> str:
    """The warcinfo record that opens every archive."""
    fields = "software: voxlattice\r\nformat: WARC File Format 1.1\r\n"
    return f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}{END}{fields}{END}"


def write(resolved: DataFrame, path: str, most: int = ARCHIVE, date: str = DATE) -> None:
    """Archives of at most `most` bytes and one more record, in a folder that all executors share; no rows move for it.

    Each task numbers its archives by the bytes that it has written so far.
    """

    def number(batches):
        at, filled = 0, 0
        for batch in batches:
            size = pc.binary_length(batch.column("value")).to_numpy(zero_copy_only=False)
            archives, opened = [], []
            for n in size.tolist():
                opened.append(not filled)
                archives.append(at)
                filled += n
                if filled >= most:
                    at, filled = at + 1, 0
            info = _info(date)
            first = pa.array([info if o else "" for o in opened], pa.string())
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(first, batch.column("value"), ""), pa.array(archives, pa.int64())], names=["value", "archive"])

    numbered = records(resolved, date).mapInArrow(number, "value string, archive long")
    numbered.write.partitionBy("archive").option("lineSep", END).text(path)


def _parse(raw: memoryview):
    """(page id or None, type, digest, record id, refers-to, payload) of each page record of an archive."""
    at, text = 0, bytes(raw)
    while at < len(text):
        end = text.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in text[at:end].decode().split("\r\n")[1:])
        stop = end + 4 + int(head["Content-Length"])
        if head["WARC-Type"] != "warcinfo":
            body = text.index(b"\r\n\r\n", end + 4, stop) + 4
            yield head.get("X-Page-ID"), head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Record-ID"], head.get("WARC-Refers-To"), text[body:stop]
        at = stop + 4


def read(spark: SparkSession, path: str) -> DataFrame:
    """(page_id string, record_type, digest, record_id, refers_to_id, payload) of every record in a folder of archives.

    A response whose payload does not have the digest its header gives raises an error. An archive is read whole (see
    write's bound), its records are handed on some megabytes at a time.
    """

    def table(found):
        return pa.RecordBatch.from_pydict({"page_id": pa.array([x[0] for x in found], pa.string()), "record_type": pa.array([x[1] for x in found], pa.string()), "digest": pa.array([x[2] for x in found], pa.string()), "record_id": pa.array([x[3] for x in found], pa.string()), "refers_to_id": pa.array([x[4] for x in found], pa.string()), "payload": pa.array([x[5].decode() for x in found], pa.string())})

    def parse(batches):
        for batch in batches:
            for raw in batch.column("content"):
                found, held = [], 0
                for record in _parse(raw.as_buffer()):
                    page, kind, digest, _, _, payload = record
                    if kind == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                        raise ValueError(f"page {page}: the payload does not have the digest of its header")
                    found.append(record)
                    held += len(payload)
                    if held > 4 << 20 or len(found) == 2000:
                        yield table(found)
                        found, held = [], 0
                yield table(found)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    return files.mapInArrow(parse, "page_id string, record_type string, digest string, record_id string, refers_to_id string, payload string")


def archive(pages: DataFrame, path: str | None = None, least: int = 0, page_id: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """Write the pages' deduplicated archives, read them back and resolve the revisits.

    Result: (page_id, payload_bytes, payload_digest, record_type, refers_to) from the archives alone; a revisit's bytes
    are those of the response it refers to. An empty table gives no rows.
    """
    spark = pages.sparkSession
    path = path or f"{C.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(resolve(pages, least, page_id, html, url), path)
    kind = pages.schema[page_id].dataType
    back = read(spark, path).select(F.col("page_id").cast(kind).alias("page_id"), "record_type", "digest", "record_id", "refers_to_id", F.octet_length("payload").cast("long").alias("size"))
    back = C.materialise(back, "warc-headers")
    originals = back.where("record_type = 'response'").groupBy("record_id").agg(F.first("page_id").alias("refers_to"), F.first("size").alias("original")).withColumnRenamed("record_id", "refers_to_id")
    # responses refer to nothing; joined with the revisits, their null keys would meet in one task
    whole = back.where("record_type = 'response'").select("page_id", "size", "digest", "record_type", F.lit(None).cast(kind).alias("refers_to"))
    revisits = back.where("record_type = 'revisit'")
    again = C.salted_join(revisits, originals, ["refers_to_id"], revisits.groupBy("refers_to_id").count(), revisits.count(), ["page_id"], "left")
    again = again.select("page_id", F.col("original").alias("size"), "digest", "record_type", "refers_to")
    return whole.unionByName(again).select("page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")
