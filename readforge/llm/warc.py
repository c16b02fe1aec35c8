"""WARC writing and the monolithic gzip normaliser (operator 7).

``write`` packs records into ``.warc.gz`` files that are one gzip stream each, as many crawlers leave them.
``normalise`` inflates each such file once, front to back and through all its members if there are several, rewrites
every record as its own gzip member and
writes a sidecar index of the members' offsets. ``read`` takes ranges of that index, and every range can be
read by another task: it reads its bytes and inflates each member by itself.

Of records with equal payloads of at least ``min_bytes`` bytes the one with the smallest page_id is a response
and the others revisit it; of repeated rows of that page one is. Null html is an empty payload; a null page_id
sorts last, and revisits of such a page have a null refers_to. A null url becomes an empty target. An empty
table gives no records. A stream that ends early, or inside a record, is an error. Files have names of their own for every attempt, and only those that finished tasks
report are read, so a lost task leaves nothing behind that counts. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, run_folder
from .storage import Reader, Writer, new_file

MIN_BYTES = 100
MOST_FILE = 256 << 20
INDEX_STEP = 512
RANGES_A_TASK = 8


def _header(fields: list[tuple[str, str]]) -> bytes:
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def record(page_id: int | None, url: str, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the digest and the length of its payload but not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if kind == "response" else b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Target-URI", " ".join(url.split())), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")]
    return _header([*fields, ("Content-Length", str(len(block)))]) + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """A record's fields, its payload and its payload's full length."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    full = next(int(line[16:]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length: "))
    number = lambda name: int(x) if (x := fields.get(name, "")[10:-1]) else None
    return {"page_id": number("WARC-Record-ID"), "refers_to": number("WARC-Refers-To"), "kind": fields["WARC-Type"], "digest": fields["WARC-Payload-Digest"][7:], "payload": payload, "bytes": full}


def records_of(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records out of a stream of inflated bytes; holds one record and one chunk at most."""
    held = bytearray()
    need = -1
    for chunk in chunks:
        held += chunk
        while True:
            if need < 0:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                at = held.rfind(b"Content-Length: ", 0, end + 2)
                need = end + 4 + int(held[at + 16 : held.find(b"\r\n", at)]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = -1
    if held:
        raise ValueError("a WARC file ends inside a record")


def _inflated(uri: str, step: int = 1 << 20) -> Iterator[bytes]:
    source, stream, at, begun = Reader(uri), zlib.decompressobj(31), 0, False
    while at < source.size:
        data = source.read_at(at, step)
        at += len(data)
        while data:
            begun = True
            yield stream.decompress(data, 4 * step)
            data = stream.unconsumed_tail
            if stream.eof:
                # more members may follow; zeros pad a file
                data, stream, begun = stream.unused_data.lstrip(b"\0"), zlib.decompressobj(31), False
    source.close()
    if begun:
        raise ValueError(f"the gzip stream of {uri} is cut off")


def _write_batches(folder: str, most_file: int):
    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = packer = None
        count = size = 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.record_batch([pa.array([out.uri]), pa.array([count], pa.int64())], names=["path", "records"])

        for batch in batches:
            for page_id, url, html, digest, kind, refers_to in zip(*(c for c in batch.columns), strict=True):
                if out is None:
                    out, packer, count, size = Writer(new_file(folder, ".warc.gz")), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                raw = record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), digest.as_py(), kind.as_py(), refers_to.as_py())
                out.write(packer.compress(raw))
                count, size = count + 1, size + len(raw)
                if size >= most_file:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return written


def typed(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, html, digest, kind, refers_to) with every row's record type.

    Types are found on digests and ids alone, so equal payloads meet as small rows that are summed before they are
    dealt out; the html is joined by page. Repeated rows of a first page are counted, and written out again from
    their number, so that no group of them is ordered.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("page_id").cast("long"), F.lit(0)).alias("_id"), F.col("page_id").isNull().alias("_none"), F.sha2(html.cast("binary"), 256).alias("digest"), F.octet_length(html).alias("n"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    key = ["_id", "_none", "digest"]
    light = materialize(rows.where(F.col("n") >= min_bytes).groupBy(*key).agg(F.count("*").alias("times"), F.min("url").alias("first_url")), "warc-light")
    first = materialize(light.groupBy("digest").agg(F.min(F.struct("_none", "_id")).alias("first"), F.sum("times").alias("same")).where("same > 1").select("digest", "first"), "warc-first")
    is_first = F.struct("_none", "_id") == F.col("first")
    again = light.join(first, "digest").select(*key, "first_url", is_first.alias("is_first"), (is_first & (F.col("times") > 1)).alias("tied"), F.when(~F.col("first._none"), F.col("first._id")).alias("first_id"))
    again = materialize(again, "warc-again")
    joined = rows.join(again.select(*key, "is_first", "tied", "first_id"), key, "left").where("tied is null or not tied").withColumn("_revisit", F.coalesce(~F.col("is_first"), F.lit(False)))
    # of repeated rows of the first page, one with the least url is the response
    copies = rows.join(again.where("tied").select(*key, "first_url", "first_id"), key).groupBy(*key, "page_id", "url", "first_url", "first_id").agg(F.count("*").alias("times"), F.first("html").alias("html"))
    copies = copies.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).withColumn("_revisit", (F.col("copy") > 1) | (F.col("url") != F.col("first_url")))
    both = joined.select("page_id", "url", "html", "digest", "_revisit", "first_id").unionByName(copies.select("page_id", "url", "html", "digest", "_revisit", "first_id"))
    return both.select("page_id", "url", "html", "digest", F.when(F.col("_revisit"), "revisit").otherwise("response").alias("kind"), F.when(F.col("_revisit"), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str, min_bytes: int = MIN_BYTES, most_file: int = MOST_FILE) -> DataFrame:
    """(path, records) of the monolithic files written."""
    return typed(pages, min_bytes).mapInArrow(_write_batches(folder, most_file), "path string, records long")


def _normalise_batches(folder: str, step: int):
    def normalised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                out = Writer(new_file(folder, ".warc.gz"))
                index = Writer(out.uri.removesuffix(".warc.gz") + ".idx")
                ranges, start, count = [], 0, 0
                for raw in records_of(_inflated(path)):
                    member = zlib.compressobj(1, zlib.DEFLATED, 31)
                    at = out.at
                    out.write(member.compress(raw) + member.flush())
                    index.write(at.to_bytes(8, "little") + (out.at - at).to_bytes(8, "little"))
                    count += 1
                    if count % step == 0:
                        ranges.append((start, index.at))
                        start = index.at
                if start < index.at:
                    ranges.append((start, index.at))
                out.close()
                index.close()
                yield pa.record_batch([pa.array([out.uri] * len(ranges)), pa.array([index.uri] * len(ranges)), pa.array([a for a, _ in ranges], pa.int64()), pa.array([b for _, b in ranges], pa.int64())], names=["path", "index", "lo", "hi"])

    return normalised


def normalise(files: DataFrame, folder: str, step: int = INDEX_STEP) -> DataFrame:
    """(path, index, lo, hi): ranges of ``step`` members in the sidecar indexes of the rewritten files.

    The number of partitions is given, one for each file, as rows of a few bytes would else be put into one task.
    """
    return files.select("path").repartition(max(1, files.count()), "path").mapInArrow(_normalise_batches(folder, step), "path string, index string, lo long, hi long")


READ_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, stored_bytes long, verified boolean"


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, index, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            places, source = Reader(index), Reader(path)
            entries = places.read_at(lo, hi - lo)
            rows = []
            for i in range(0, len(entries), 16):
                at, size = int.from_bytes(entries[i : i + 8], "little"), int.from_bytes(entries[i + 8 : i + 16], "little")
                r = parse(zlib.decompress(source.read_at(at, size), 31))
                whole = r["kind"] == "revisit" or (len(r["payload"]) == r["bytes"] and hashlib.sha256(r["payload"]).hexdigest() == r["digest"])
                rows.append((r["page_id"], r["bytes"], r["digest"], r["kind"], r["refers_to"], size, whole))
            places.close()
            source.close()
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "stored_bytes", "verified"])


def read(ranges: DataFrame) -> DataFrame:
    """One row for each record of the ranges, from its own gzip member."""
    return ranges.repartition(max(1, ranges.count() // RANGES_A_TASK), "path", "lo").mapInArrow(_read_batches, READ_SCHEMA)


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write, normalise and read back."""
    folder = run_folder(spark, "warc")
    files = materialize(write(pages, f"{folder}/raw"), "warc-files")
    ranges = materialize(normalise(files, f"{folder}/members"), "warc-ranges")
    return read(ranges)


def op7_warc_normaliser(spark, sf_dir):
    return archive(spark, read_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified")


OP7_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to, true AS verified FROM f
"""
