"""WARC archives: writing, reading, and resolution of revisit records.

Only headers are shuffled to find equal payloads: the pages' digests and sizes
are grouped, the groups of two or more give the original each, and a second join
of headers gives the list of pages that revisit one. Payloads meet that list by
page id, so the many copies of one payload are not dealt to one task. Archives
are .warc.gz files, each record a gzip member of its own, so that readers can
seek to it, behind a warcinfo record. They are written by Spark's text writer,
whose commit protocol covers them, with an empty gzip member as line separator:
a lost task is written again and no half file is read. A gzip file is read by
one task, so records_per_file bounds what a task reads. Reading splits the stream at
the version line and puts records together by their Content-Length, so payloads
that hold that line, or blank lines, come back whole and memory holds one batch
of records.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dropped, remove, shared_folder, written

VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "<urn:lodestone:page:"
SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, payload_digest string, refers_to string, payload binary"
_ID = re.compile(re.escape(RECORD) + r"(-?\d+|null)>")


def payload(html: Column) -> Column:
    """The html in UTF-8; null is the empty payload."""
    return F.coalesce(html, F.lit("")).cast("binary")


def revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """`pages` with payload_bytes, payload_digest, record_type, refers_to and refers_to_uri.

    Pages with equal payloads of at least `least` bytes (equal SHA-1 and size):
    the largest id is the response, the others revisit it; rows that repeat its
    id are responses too. Smaller payloads are all responses. A null id is the
    smallest. Null htmls are empty payloads; very long ones are hashed whole.
    Columns of the input that have the names of new ones are renamed input_...
    An empty table stays empty.
    """
    if clash := {"payload_bytes", "payload_digest", "record_type", "refers_to", "refers_to_uri", "original", "again_id", "again_digest", "again_bytes"} & set(pages.columns):
        pages = pages.withColumnsRenamed({c: f"input_{c}" for c in clash})
    head = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), F.octet_length(payload(F.col(html_col))).cast("long").alias("payload_bytes"), F.unhex(F.sha1(payload(F.col(html_col)))).alias("payload_digest"))
    many = head.where(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(F.max(F.struct("id", "uri")).alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    many = written(many, "warc-originals")
    alike = ["payload_digest", "payload_bytes"]
    again = head.join(many, alike).where(~F.col("original.id").eqNullSafe(F.col("id")))
    again = written(again.select(F.col("id").alias("again_id"), F.col("payload_digest").alias("again_digest"), F.col("payload_bytes").alias("again_bytes"), "original").distinct(), "warc-again")
    dropped(many)
    own = pages.withColumns({"payload_bytes": F.octet_length(payload(F.col(html_col))).cast("long"), "payload_digest": F.unhex(F.sha1(payload(F.col(html_col))))})
    same = F.col(id_col).eqNullSafe(F.col("again_id")) & (F.col("payload_digest") == F.col("again_digest")) & (F.col("payload_bytes") == F.col("again_bytes"))
    joined = own.join(again, same, "left").drop("again_id", "again_digest", "again_bytes")
    return joined.withColumns({
        "payload_digest": F.lower(F.hex("payload_digest")), "record_type": F.when(F.col("original").isNotNull(), "revisit").otherwise("response"),
        "refers_to": F.col("original.id"), "refers_to_uri": F.col("original.uri"),
    }).drop("original")


def _uri(url: Column) -> Column:
    return F.regexp_replace(url, r"[\x00-\x20\x7F]", "%20")


def _record_id(page: Column) -> Column:
    return F.concat(F.lit(RECORD), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, date: str = "1970-01-01T00:00:00Z", records_per_file: int = 4000, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> None:
    """Write what `revisits` returns as WARC files under `path`, with fresh headers, each record compressed by itself.

    A response holds an HTTP head and the payload, a revisit the HTTP head only.
    White space and control characters in a url are written as %20; a null url
    has no target header. A file begins with a warcinfo record and has
    records_per_file records at most. An empty table gives no record.
    """
    line = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    again = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    size = F.octet_length(http) + F.when(again, F.lit(0)).otherwise(F.col("payload_bytes"))
    record = F.concat(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _record_id(F.col(id_col))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _uri(F.col(url_col))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _record_id(F.col("refers_to"))), line("WARC-Refers-To-Target-URI", _uri(F.col("refers_to_uri"))), line("WARC-Refers-To-Date", F.lit(date)))).otherwise(""),
        line("Content-Type", F.lit("application/http;msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"),
        http, F.when(again, F.lit("")).otherwise(F.coalesce(F.col(html_col), F.lit(""))),
    )
    info = b"software: lodestone\r\nformat: WARC File Format 1.1\r\n"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = 0
        for pdf in batches:
            out = []
            for value in pdf["value"]:
                if n % records_per_file == 0:
                    name = uuid.uuid5(uuid.NAMESPACE_URL, f"lodestone:{len(value)}:{hashlib.sha1(value).hexdigest()}")
                    head = f"{VERSION}WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    out.append(gzip.compress(head.encode() + info + b"\r\n\r\n", mtime=0))
                    n += 1
                out.append(gzip.compress(value, mtime=0))
                n += 1
            yield pd.DataFrame({"value": out})

    if records_per_file < 2:
        raise ValueError("a file holds a warcinfo record and one record at least")
    members = resolved.select(F.concat(record, F.lit("\r\n\r\n")).cast("binary").alias("value")).mapInPandas(run, "value binary")
    # the bytes go through as they are; between members stands one that holds nothing
    empty = gzip.compress(b"", mtime=0).decode("latin-1")
    writer = members.select(F.col("value").cast("string")).write.option("lineSep", empty).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", records_per_file)
    writer.text(path)
    _renamed(resolved.sparkSession, path)


def _renamed(spark: SparkSession, path: str) -> None:
    """The committed part files get names that say what they hold, which readers go by."""
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for f in fs.listStatus(fs_path(path)):
        name = f.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(f.getPath(), fs_path(f"{path}/{name.removesuffix('.txt')}.warc.gz"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of gzipped WARC files but for their warcinfo: type, id, target, date, payload digest (as written), refers_to, payload (of responses).

    A record cut short raises ValueError, as does a response whose payload does
    not have the SHA-1 that its header names.
    """
    pieces = spark.read.option("lineSep", VERSION).text(path).select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"))
    columns = [x.split()[0] for x in SCHEMA.split(", ")]
    mark = VERSION.encode()

    def parse(raw: bytes) -> tuple | None:
        """The record, nothing of a warcinfo record, or None where more must follow."""
        head, gap, rest = raw.partition(b"\r\n\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8").split("\r\n"))}
        if not gap or "content-length" not in fields or len(rest) < int(fields["content-length"]) + 4:
            return None
        if fields["warc-type"] == "warcinfo":
            return ()
        block = rest[: int(fields["content-length"])]
        body = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
        digest = fields.get("warc-payload-digest", "")
        if fields["warc-type"] == "response" and digest.startswith("sha1:") and len(digest) == 45 and hashlib.sha1(body).hexdigest() != digest[5:]:
            raise ValueError(f"payload of {fields.get('warc-record-id')} is damaged")
        return (fields["warc-type"], fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-date"), digest or None, fields.get("warc-refers-to"), body if fields["warc-type"] != "revisit" else None)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, file = b"", None
        for pdf in batches:
            out = []
            for value, name in zip(pdf["value"], pdf["file"], strict=True):
                if name != file:
                    if held:
                        raise ValueError(f"{file} ends within a record")
                    file = name
                    if not value:  # what stands before the first record
                        continue
                held = held + mark + value if held else bytes(value)
                row = parse(held)
                if row is not None:
                    held = b""
                if row:
                    out.append(row)
            yield pd.DataFrame(out, columns=columns)
        if held:
            raise ValueError(f"{file} ends within a record")

    return pieces.mapInPandas(run, SCHEMA)


def resolve(records: DataFrame) -> DataFrame:
    """One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A revisit's bytes come from the response it refers to, by a join on the
    response's id and digest.
    """
    number = lambda c: F.regexp_extract(c, r"page:(-?\d+)>", 1)
    page = lambda c: F.when(number(c) != "", number(c).cast("long"))
    heads = records.select(
        "record_type", page("record_id").alias("page_id"), F.expr("substring(payload_digest, 6)").alias("payload_digest"), page("refers_to").alias("refers_to"), F.octet_length("payload").cast("long").alias("own"),
    )
    heads = written(heads, "warc-heads")
    again = heads.where("record_type = 'revisit'").drop("own")
    bytes_ = heads.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("own").alias("payload_bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    done = again.join(bytes_, ["refers_to", "payload_digest"], "left").select(*columns)
    return heads.where("record_type <> 'revisit'").withColumn("payload_bytes", F.col("own")).select(*columns).unionByName(done)


def archived(pages: DataFrame, least: int = 1000, folder: str | None = None) -> DataFrame:
    """Write `pages` (page_id, url, html) as deduplicated archives, read them back and resolve the revisits.

    folder: where the archives stay; without it they go to the shared folder and
    are removed once their headers are read.
    """
    spark = pages.sparkSession
    path = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(revisits(pages, least), path)
    out = resolve(read_archives(spark, path))
    if folder is None:
        remove(spark, path)
    return out
