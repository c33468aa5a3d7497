"""WARC archives: writing, and reading back by boundary-chain verification.

A record's header says where its successor starts. Reading does not trust the magic string alone, which
may stand inside a payload: tasks emit every candidate with the offset of its successor, and pointer
jumping from each file's start retains the candidates that the chain really reaches.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlens.llm.common import map_rows, shared_table
from threadlens.session import ensure_checkpoint_dir

#: Fixed values of the format.
VERSION = "WARC/1.0"
END = "\r\n\r\n"
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
PAGE = re.compile(r"<urn:page:(-?[0-9]+)>")

CANDIDATE = ("file string, at long, successor long, page_id long, record_type string, payload_bytes long, "
             "payload_digest string, refers_to long")


def lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a pair with a null value is left out."""
    return F.concat(*[F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit("")) for name, value in pairs])


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, refers_to (null for responses).

    Of equal payloads of ``least_bytes`` or more, the one with the largest page_id is a response (a null
    id counts as the smallest; rows that share the largest id are all responses), the others refer to it.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    records = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    records = records.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    large = F.col("payload_bytes") >= least_bytes
    # partial sums per task first: a payload on a third of the pages is one row for each task
    first = (records.where(large).groupBy("payload_digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
             .where("n > 1 AND keeper IS NOT NULL").select(F.col("payload_digest").alias("of"), "keeper"))
    first = shared_table(first, "first-seen")
    refers = F.when(large & (F.col("page_id").isNull() | (F.col("page_id") < F.col("keeper"))), F.col("keeper"))
    return records.join(first, (F.col("payload_digest") == F.col("of")) & large, "left").withColumn("refers_to", refers).drop("of", "keeper")


def record_text(date: str) -> Column:
    """One record as text, without the blank lines that end it."""
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    header = lines(
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20]", "")),
        ("WARC-Refers-To", F.when(revisit, urn(F.col("refers_to")))),
        ("WARC-Profile", F.when(revisit, F.lit("http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"))),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("Content-Type", F.lit("application/http; msgtype=response")),
        ("Content-Length", F.octet_length(block)))
    return F.concat(F.lit(VERSION + "\r\n"), header, F.lit("\r\n"), block)


def write_archives(pages: DataFrame, path: str, records_per_archive: int = 10_000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; others are ignored) into archives below ``path``.

    Archives are gzipped WARC files, written by Spark's own text writer (the blank lines between records are its
    line separator), so any store that Spark reaches will do. A file holds one partition of the join that
    finds equal payloads (Spark's advisory partition size), at most ``records_per_archive`` records. A null
    html is an empty payload, a null url leaves its header out, a null id gets a random record id. An empty
    table gives no record.
    """
    records = plan_records(pages).select(record_text(date).alias("value"))
    options = {"lineSep": END, "compression": "gzip", "maxRecordsPerFile": str(records_per_archive)}
    records.write.options(**options).text(path)


def parse(content: bytes, at: int, head: int) -> tuple | None:
    """(successor, page_id, type, payload bytes, digest, refers_to) of a candidate; None without a usable header.

    ``head``: where the version line ends. Digest and length are taken from the payload itself; a revisit has
    them from its headers.
    """
    fields, start = {}, head
    while (end := content.find(b"\r\n", start)) != start:
        name, colon, value = content[start : max(end, start)].decode("utf-8", "replace").partition(":")
        if not colon:  # no header line (or no line end): a magic inside a payload costs one line, not a scan
            return None
        fields[name.strip().lower()] = value.strip()
        start = end + 2
    if not fields.get("content-length", "").isascii() or not fields.get("content-length", "").isdigit():
        return None
    block, stop = end + 2, end + 2 + int(fields["content-length"])
    if stop + 4 > len(content) or content[stop : stop + 4] != b"\r\n\r\n":
        return None
    kind, number = fields.get("warc-type"), lambda name: int(m[1]) if (m := PAGE.fullmatch(fields.get(name, ""))) else None
    http = content.find(b"\r\n\r\n", block, stop)
    payload = memoryview(content)[http + 4 if http >= 0 else block : stop]
    if kind == "revisit":
        m = re.search(rb"\r\nContent-Length: ([0-9]+)\r\n", content[block : http + 2]) if http >= 0 else None
        size, digest = int(m[1]) if m else None, fields.get("warc-payload-digest", "").removeprefix("sha1:")
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return stop + 4, number("warc-record-id"), kind, size, digest, number("warc-refers-to")


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every place in the archives below ``path`` that reads like a record, with its successor's offset.

    Places inside payloads are among them; an archive without records (or no archive) gives no rows, a header that does not
    parse is no candidate, and equal archives under several names are read as often.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
        for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            content = content.as_py()
            if content[:2] == b"\x1f\x8b":
                content = gzip.decompress(content)  # offsets are those of the records, not of the packed file
            for m in MAGIC.finditer(content):
                if (found := parse(content, m.start(), m.end())) is not None:
                    yield (name, m.start(), *found)

    return map_rows(files, rows, CANDIDATE)


def reachable(found: DataFrame) -> DataFrame:
    """The candidates that lie on the chain from their file's start (offset 0).

    ``found``: file, at, successor. With jumps of 1, 2, 4, ... records, the reached offsets double each
    round, so the number of rounds is the logarithm of the longest chain; each round is two joins of
    slim rows by (file, offset). None of these tables is broadcast: they grow with the archives, but their names
    and offsets take so little on disk that size estimates are far below what they take in memory.
    """
    jump = shared_table(found.select("file", "at", F.col("successor").alias("to")), "jumps")
    places = jump.select("file", "at")
    reached = shared_table(jump.where("at = 0").select("file", "at"), "reached")
    count = reached.count()
    while True:
        onward = reached.join(jump.hint("merge"), ["file", "at"]).select("file", F.col("to").alias("at"))
        onward = onward.join(places.hint("merge"), ["file", "at"], "left_semi")  # only offsets that hold a candidate count
        reached = shared_table(reached.union(onward).distinct(), "reached")
        now = reached.count()
        if now == count:
            break
        count = now
        after = jump.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        jump = shared_table(jump.join(after.hint("merge"), ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jumps")
    return found.join(reached.hint("merge"), ["file", "at"], "left_semi")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record below ``path``.

    A record without a page id has a null one; repeated records come as often; bytes behind the last whole record of an
    archive are no record.
    """
    found = shared_table(candidates(spark, path), "candidates")
    return reachable(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back and return one row per page.

    Null ids come back null; repeated rows come back as often; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    return read_archives(spark, path)
