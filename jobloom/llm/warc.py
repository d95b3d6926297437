"""WARC archives: a writer with revisit records, and a splittable reader.

Writer: every page is one gzip member, so any member can be read alone. Spark's own text writer stores the members (a
gzip member ends in a zero byte, and the zero byte is the line separator), so files appear only when a task commits.
Reader: files are cut into byte ranges; a task scans its range for the gzip magic, checks a candidate by decoding its
header, and owns the records that start inside its range, reading past its end to finish the last one.

Edge cases: null html is an empty payload; a null url is left out of the header; a null page_id is written as such and
read back as null; rows with the page_id of the response are responses too; an empty table makes no record; other
columns are not stored. Payloads of any length work (a member whose last byte isn't zero gets an empty member behind).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import shared_dir

MAGIC, SALTS, SPLIT_BYTES, CHUNK, LEAST, TASKS = b"\x1f\x8b\x08", 32, 8 << 20, 1 << 18, 1 << 12, 64
DATE = "1970-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def member(data: bytes) -> bytes:
    """data as gzip that ends in a zero byte."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    return out if out[-1] == 0 else out + member(b"")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit that names the page it repeats."""
    urn = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {i}')}>"
    body = b"" if refers_to is not None else HTTP + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    head += ["WARC-Payload-Digest: sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode(), f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {urn(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def with_first(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, url, html and `refers_to`: the smallest page_id with the same payload, null for that page itself.

    Only payloads that occur more than once meet in the join; each is dealt over SALTS keys, so a payload that a third
    of all pages share is spread as well.
    """
    keyed = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("__digest"), F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).alias("__salt"))
    sized = pages.select("page_id", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("__digest"), F.octet_length(F.coalesce("html", F.lit(""))).alias("__bytes"))
    firsts = sized.where(F.col("__bytes") >= min_bytes).groupBy("__digest").agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1")
    firsts = firsts.select("__digest", "__first", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("__salt"))
    same = F.col("page_id").eqNullSafe(F.col("__first"))
    return keyed.join(firsts, ["__digest", "__salt"], "left").select("page_id", "url", "html", F.when(~same, F.col("__first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, min_bytes: int = 0) -> None:
    """One record per row of pages (page_id, url, html), in files of gzip members under path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = batch.slice(start, 256).to_pylist()
                made = [member(record(r["page_id"], r["url"], (r["html"] or "").encode(), r["refers_to"]))[:-1] for r in rows]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["member"])

    made = with_first(pages, min_bytes).mapInArrow(run, "member binary")
    made.select(F.col("member").cast("string").alias("value")).write.option("lineSep", "\0").text(path)


def parse(data: bytes) -> dict:
    """The fields of one record."""
    head, _, body = data.partition(b"\r\n\r\n")
    lines = [x.split(":", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in x]
    fields = {k.strip().lower(): v.strip() for k, v in lines}
    body = body[: int(fields.get("content-length", 0))]
    kind, number = fields.get("warc-type"), lambda k: int(fields[k]) if re.fullmatch(r"-?\d+", fields.get(k, "")) else None
    payload = body.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else body
    full = kind != "revisit"
    return {
        "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "record_type": kind, "payload": payload if full else None,
        "payload_bytes": len(payload) if full else number("x-payload-length"),
        "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode() if full else fields.get("warc-payload-digest", "").removeprefix("sha1:"),
        "refers_to": number("x-refers-to-page"),
    }


class Source:
    """Bytes of a file from any place, read in chunks; recent chunks are kept."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.data = file, size, 0, b""

    def get(self, at: int) -> bytes:
        """At least LEAST bytes from `at` on, or all up to the end of the file."""
        if not self.at <= at or min(self.size, at + LEAST) > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(CHUNK, max(0, self.size - at)), at)
        return self.data[at - self.at :]

    def find(self, what: bytes, at: int, end: int) -> int:
        """The first place of `what` that starts in [at, end), or -1."""
        while at < end and (data := self.get(at)):
            k = data.find(what)
            if k >= 0:
                return at + k if at + k < end else -1
            at += max(1, len(data) - len(what) + 1)
        return -1

    def unpack(self, at: int) -> tuple[bytes, int] | None:
        """(the WARC record in the gzip member at `at`, where the member ends); None if there is none."""
        stream, out, first = zlib.decompressobj(31), [], True
        try:
            while data := self.get(at):
                out.append(stream.decompress(data))
                if first and not out[0].startswith(b"WARC/"):
                    return None
                first, at = False, at + len(data) - len(stream.unused_data)
                if stream.eof:
                    return b"".join(out), at
        except zlib.error:
            pass
        return None


def records(file, size: int, start: int, end: int) -> Iterator[dict]:
    """The records that start in [start, end) of an open file."""
    source, at = Source(file, size), start
    while (at := source.find(MAGIC, at, end)) >= 0:
        if found := source.unpack(at):
            yield parse(found[0])
            at = found[1]
        else:
            at += 1


SCHEMA = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"
SCHEMA_PA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def read_archives(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """All records of the archives under path, whatever the size of a file.

    The list of ranges is dealt by number (so that it isn't taken for a small table and read by one task): a task for
    each range up to TASKS a core, then several ranges a task.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "length").where("length > 0")
    count = files.agg(F.coalesce(F.sum(F.expr(f"(length + {split_bytes - 1}L) div {split_bytes}L")), F.lit(0))).first()[0]
    tasks = max(1, min(count, TASKS * spark.sparkContext.defaultParallelism))
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0L, length - 1, {split_bytes}L)")).alias("start")).repartition(tasks)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for r in batch.to_pylist():
                store, name = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", r["path"]))
                with store.open_input_file(name) as file:
                    held, size = [], 0
                    for x in records(file, r["length"], r["start"], r["start"] + split_bytes):
                        size += len(x["payload"] or b"")
                        held.append(x if payload else x | {"payload": None})
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, SCHEMA_PA)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, SCHEMA_PA)

    return ranges.mapInArrow(run, SCHEMA)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(x, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p
"""
