"""WARC archives compressed record by record against a shared dictionary.

A file begins with a skippable frame that holds a Zstandard dictionary trained
on records of the table; then every record is a frame of its own, so a reader
can start at any record. A payload that several pages share is stored once, by
the page of the largest id; the others are revisit records that refer to it.

The dictionary is fitted on a bounded sample (``SAMPLE`` records, the
first ``SAMPLE_BYTES`` of each), the rest of the work covers every row.

Defined results: a NULL or empty html is an empty payload, which revisits like
any other; a payload of any length is one record; rows that repeat the page id
of a response are all responses; a NULL ``page_id`` is written as such, never
the response where another id has the payload; an empty table writes no file. Columns
other than ``page_id``, ``url`` and ``html`` are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import words as W
from plumbline.llm.common import AtomicFile, map_texts, open_file, keep_table, pieces
from plumbline.session import fresh_folder

SAMPLE, SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 1000, 1 << 16, 112_640, 3
FILE_BYTES, DATE = 1 << 28, "1970-01-01T00:00:00Z"
#: Fixed values of the file format: the skippable frame, and the profile of a revisit.
MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_digest, payload_bytes."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(part, texts: W.Texts):
        raw = [texts.data[a:z].tobytes() for a, z in zip(texts.offsets[:-1], texts.offsets[1:])]
        return {"page_id": part.column("page_id"), "payload_digest": list(map(payload_digest, raw)), "payload_bytes": pa.array(map(len, raw), pa.int64())}

    return map_texts(pages.select("page_id", "html"), run, f"page_id {kind}, payload_digest string, payload_bytes bigint", "html")


def dictionary(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of records chosen by hash among all that are not empty; empty if there are none."""
    marked = pages.filter(F.octet_length("html") > 0).select("html", F.xxhash64("page_id", "html").alias("mark"))
    chosen = marked.select("mark").distinct().orderBy("mark").limit(SAMPLE)
    begun = F.substring(F.encode("html", "UTF-8"), 1, SAMPLE_BYTES).alias("begun")
    found = sorted({bytes(r["begun"]) for r in marked.join(F.broadcast(chosen), "mark", "left_semi").select(begun).distinct().collect()})  # SAMPLE rows
    if not found:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, found).as_bytes()
    except zstandard.ZstdError:  # too few records to train on: their bytes serve as they are
        return b"".join(found)[-DICTIONARY_BYTES:]


def _record(kind: str, page_id, url, digest: str, size: int, refers_to, payload: bytes) -> bytes:
    block = b""
    if kind == "response":
        block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    name = lambda i: f"<urn:page-id:{'null' if i is None else i}>"
    uri = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}",
            "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_archives(pages: DataFrame, least: int = 0) -> tuple[str, DataFrame]:
    """Write a folder of archives; the folder, and its files: name, bytes, records.

    Payloads of fewer than ``least`` bytes are always stored whole.
    """
    spark = pages.sparkSession
    folder = fresh_folder(spark, "warc")
    kind = pages.schema["page_id"].dataType.simpleString()
    marks = digests(pages)
    # Shared payloads only: one row each, combined before the shuffle.
    shared = marks.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "payload_bytes").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = keep_table(shared, "warc-shared")
    book = dictionary(pages)

    def mark(part, texts: W.Texts):
        raw = [texts.data[a:z].tobytes() for a, z in zip(texts.offsets[:-1], texts.offsets[1:])]
        return {"page_id": part.column("page_id"), "url": part.column("url"), "html": part.column("html"),
                "payload_digest": list(map(payload_digest, raw)), "payload_bytes": pa.array(map(len, raw), pa.int64())}

    marked = map_texts(pages.select("page_id", F.col("url").cast("string").alias("url"), "html"), mark,
                       f"page_id {kind}, url string, html string, payload_digest string, payload_bytes bigint", "html")
    ready = marked.join(shared, ["payload_digest", "payload_bytes"], "left").withColumn(
        "refers_to", F.when(F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")), F.col("keeper"))).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "payload_digest", "payload_bytes", "refers_to")

    def write(batches):
        task, number, out, records, made = TaskContext.get().partitionId(), 0, None, 0, []
        squeeze = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(book) if book else None)

        def close():
            out.close()
            made.append((f"part-{task}-{number}.warc.zst", out.size, records))

        for batch in batches:
            for part, _ in pieces(batch, "html"):
                for page_id, url, html, digest, size, refers_to in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        out = AtomicFile(folder, f"part-{task}-{number}.warc.zst")
                        out.write(struct.pack("<II", MAGIC, len(book)) + book)
                    which = "response" if refers_to is None else "revisit"
                    out.write(squeeze.compress(_record(which, page_id, url, digest, size, refers_to, (html or "").encode())))
                    records += 1
                    if out.size >= FILE_BYTES:
                        close()
                        out, number, records = None, number + 1, 0
        if out is not None:
            close()
        yield pa.RecordBatch.from_pydict({"name": pa.array([m[0] for m in made], pa.string()), "bytes": pa.array([m[1] for m in made], pa.int64()),
                                          "records": pa.array([m[2] for m in made], pa.int64())})

    return folder, keep_table(ready.mapInArrow(write, "name string, bytes bigint, records bigint"), "warc-files")


def read_records(source):
    """Header fields (lower-case names) and block of every record of an open archive."""
    def chunks():
        while part := source.read(1 << 20):
            yield part

    magic, size = struct.unpack("<II", source.read(8))
    if magic != MAGIC:
        raise ValueError("not an archive with a dictionary")
    book = source.read(size)
    plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(book) if book else None)
    frame, text, rest = plain.decompressobj(), [], b""
    stream = chunks()
    while rest or (rest := next(stream, b"")):
        text.append(frame.decompress(rest))
        rest = b""
        if frame.eof:
            head, _, body = b"".join(text).partition(b"\r\n\r\n")
            rest = frame.unused_data
            frame, text = plain.decompressobj(), []
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            fields = {k.lower(): v for k, v in fields.items()}
            yield fields, body[:int(fields["content-length"])]
    if text:
        raise ValueError("an archive ends inside a record")


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


def read_archives(folder: str, files: DataFrame, kind: str, payloads: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if asked for.

    A response's length and digest are those of the payload read; a wrong one is an error.
    """
    number = lambda uri: None if uri[len("<urn:page-id:"):-1] == "null" else uri[len("<urn:page-id:"):-1]
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * payloads

    def run(batches):
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with open_file(folder, name) as f:
                    for fields, block in read_records(f):
                        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                        body = payload_of(block)
                        if fields["warc-type"] == "response" and (len(body), payload_digest(body)) != (size, digest):
                            raise ValueError(f"damaged record {fields['warc-record-id']} in {name}")
                        refers_to = number(fields["warc-refers-to"]) if "warc-refers-to" in fields else None
                        rows.append((number(fields["warc-record-id"]), fields["warc-target-uri"], size, digest, fields["warc-type"], refers_to) + (body,) * payloads)
                        held += len(body) * payloads
                        if len(rows) == 1000 or held > 1 << 22:
                            yield table(rows)
                            rows, held = [], 0
                if rows:
                    yield table(rows)

    def table(rows):
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "page_id string, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to string" + ", payload binary" * payloads
    spread = files.select("name").repartition(max(1, files.count()))
    return spread.mapInArrow(run, schema).withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


def op9(pages: DataFrame) -> DataFrame:
    kind = pages.schema["page_id"].dataType.simpleString()
    return read_archives(*write_archives(pages), kind).drop("url")


_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST('0x' || substr(hex, {1 + 10 * q}, 10) AS BIGINT) >> {35 - 5 * k}) & 31 AS INTEGER), 1)"
                      for q in range(4) for k in range(8))
SQL = f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS hex FROM pages),
 k AS (SELECT body, max(page_id) AS keeper FROM p GROUP BY body)
 SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
   CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keeper THEN keeper END AS refers_to
 FROM p JOIN k USING (body)"""
