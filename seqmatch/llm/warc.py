"""WARC archives of pages, and their records as a table of chunks.

Archives are ordinary ``.warc.gz`` files: every record is a gzip member of its own.  Reading streams: a record becomes
rows (record id, chunk number, bytes, running digest), so neither a payload nor a member is ever held as a whole, and
the digest of a payload is that in the row of its last chunk.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, materialize, may_be_in, new_path

CHUNK = 1 << 20
LEAST = 100
ROLL = 1 << 28
_READ = 1 << 16
_FLUSH = 1 << 23


def _open(uri: str, mode: str):
    """A stream of any file system that pyarrow knows (local, hdfs, s3, gs); parents of a written file are made."""
    from pyarrow import fs

    at, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1) if "://" in uri else f"file://{uri}")
    if mode == "r":
        return at.open_input_stream(path, compression=None)
    at.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return at.open_output_stream(path, compression=None)


def plan_records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, __payload, __digest and __first (the page_id that a revisit refers to, else null) of pages.

    Of pages with equal payloads of ``least`` bytes or more, that with the smallest page_id is the response.  Only
    digests are grouped, with map-side combination.  A digest that occurs once needs no partner: a bitmap of bounded
    size of the repeated ones lets its page stay where it is, and only pages that may have one are shuffled with their
    payload to meet their group's first page_id, by a join whose hot digests adaptive execution can split.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("__payload"))
    rows = rows.withColumn("__digest", F.sha2("__payload", 256)).withColumn("__h", F.xxhash64("__digest"))
    first = rows.where(F.octet_length("__payload") >= least).groupBy(F.col("__digest").alias("__d")).agg(F.min("page_id").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 1").drop("__n")
    first = materialize(first, "repeated")
    rows = may_be_in(rows, "__h", bitmap(first.select(F.xxhash64("__d").alias("h"))), "__may").drop("__h")
    met = rows.where("__may").join(first.hint("merge"), F.col("__digest") == F.col("__d"), "left").drop("__d", "__may")
    met = met.withColumn("__first", F.when(F.col("page_id") > F.col("__first"), F.col("__first")))
    alone = rows.where("not __may").drop("__may").withColumn("__first", F.lit(None).cast(pages.schema["page_id"].dataType))
    return met.unionByName(alone)


def header(page_id: int | None, url: str | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """Header block of a record.  A revisit has no payload; its digest and length are those of the full payload."""
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {size if refers_to is None else 0}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n"


def write(pages: DataFrame, path: str | None = None, least: int = LEAST, roll: int = ROLL, level: int = 1) -> DataFrame:
    """Write one record for each page and return the archives: (archive, records, bytes), read from a written manifest.

    Each task writes files under names of its own, rolled at ``roll`` bytes, and reports them; the manifest holds what
    the successful attempts reported, so files of lost or repeated attempts are never read.
    * null html: an empty payload; null url: an empty one; null page_id: a response of its own without a number.
    * repeated page_id: a record each; equal payloads under one page_id are all responses.
    * a very long payload is compressed and written chunk by chunk; no compressed record is held as a whole.
    * other columns of ``pages``, however named, are not read.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    rows = plan_records(pages, least).select("page_id", "url", "__payload", "__digest", "__first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, n, size = "", None, 0, 0

        def report() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["archive", "records", "bytes"])

        try:
            for batch in batches:
                for page_id, url, payload, digest, refers_to in zip(*batch.columns, strict=True):
                    if out is None:
                        name, n, size = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = _open(name, "w")
                    body, first = payload.as_buffer(), refers_to.as_py()
                    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                    view = memoryview(body)[: 0 if first is not None else body.size]
                    head = header(page_id.as_py(), url.as_py(), digest.as_py(), body.size, first)
                    for piece in (head, *(slice(i, i + CHUNK) for i in range(0, len(view), CHUNK)), b"\r\n\r\n"):
                        part = packer.compress(view[piece] if isinstance(piece, slice) else piece)
                        size += out.write(part)
                    size += out.write(packer.flush())
                    n += 1
                    if size >= roll:
                        out.close()
                        out = None
                        yield report()
            if out is not None:
                out.close()
                out = None
                yield report()
        finally:
            if out is not None:
                out.close()

    rows.mapInArrow(run, "archive string, records long, bytes long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


class _Members:
    """Bytes of a gzip file of many members, as they come; never more than a chunk at a time."""

    def __init__(self, stream):
        self.stream, self.unpacker, self.rest, self.held = stream, None, b"", b""

    def _more(self, most: int) -> bytes:
        while True:
            if self.unpacker is None:
                if not self.rest:
                    self.rest = self.stream.read(_READ)
                if not self.rest:
                    return b""
                self.unpacker = zlib.decompressobj(31)
            data = self.unpacker.decompress(self.rest, most)
            if self.unpacker.eof:
                self.rest, self.unpacker = self.unpacker.unused_data, None
            else:
                self.rest = self.unpacker.unconsumed_tail
                if not data and not self.rest:
                    self.rest = self.stream.read(_READ)
                    if not self.rest:
                        raise EOFError("archive ends within a record")
            if data:
                return data

    def read(self, most: int) -> bytes:
        """Up to ``most`` bytes; nothing only at the end."""
        if not self.held:
            self.held = self._more(max(most, _READ))
        out, self.held = self.held[:most], self.held[most:]
        return out

    def line(self) -> bytes:
        out = io.BytesIO()
        while True:
            part = self.held or self._more(_READ)
            if not part:
                return out.getvalue()
            cut = part.find(b"\n")
            if cut >= 0:
                out.write(part[: cut + 1])
                self.held = part[cut + 1 :]
                return out.getvalue()
            out.write(part)
            self.held = b""


def records(stream, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, str, int, bool]]:
    """(headers, chunk number, bytes, digest of the payload so far, bytes so far, whether it is the last chunk)."""
    source = _Members(stream)
    while True:
        line = source.line()
        while line in (b"\r\n", b"\n"):
            line = source.line()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head: dict[str, str] = {}
        while (line := source.line().rstrip(b"\r\n")):
            key, _, value = line.decode().partition(":")
            head[key.lower()] = value.strip()
        left, so_far, number, digest = int(head["content-length"]), 0, 0, hashlib.sha256()
        while True:
            parts, want = [], min(chunk, left)
            while want:
                part = source.read(want)
                if not part:
                    raise EOFError("archive ends within a payload")
                parts.append(part)
                want -= len(part)
            body = b"".join(parts)
            digest.update(body)
            left, so_far = left - len(body), so_far + len(body)
            yield head, number, body, digest.hexdigest(), so_far, not left
            number += 1
            if not left:
                break


_CHUNKS = "page_id long, url string, record_type string, refers_to long, declared_digest string, declared_bytes long, chunk_no long, chunk_bytes long, bytes_so_far long, digest_so_far string, is_last boolean"


def read(archives: DataFrame, payload: bool = True, only_last: bool = False, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of the archives: a row for each chunk of at most ``chunk`` bytes of each record.

    A record without payload has one empty chunk.  ``payload`` adds the chunk's bytes; ``only_last`` returns the last
    chunk of each record only, whose running digest and length are the payload's.
    """
    schema = _CHUNKS + (", payload binary" if payload else "")
    parts = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = archives.select("archive").repartition(parts, "archive")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix("<urn:page:").removesuffix(">")
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False)], names=names)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                out, held = [], 0
                with _open(name, "r") as stream:
                    for head, no, body, digest, so_far, last in records(stream, chunk):
                        if only_last and not last:
                            continue
                        out.append((number(head["warc-record-id"]), head["warc-target-uri"], head["warc-type"], number(head.get("warc-refers-to")), head["warc-payload-digest"].removeprefix("sha256:"), int(head["warc-payload-length"]), no, len(body), so_far, digest, last, *([body] if payload else [])))
                        held += len(body) if payload else 256
                        if held >= _FLUSH:
                            yield flush()
                            out, held = [], 0
                if out:
                    yield flush()

    return files.mapInArrow(run, schema)


def summary(chunks: DataFrame) -> DataFrame:
    """One row for each record from its last chunk: page_id, payload_bytes, payload_digest, record_type, refers_to.

    A response's length and digest are those that reading its chunks gave; a revisit's are the ones it was written with.
    """
    own = F.col("record_type") == "response"
    return chunks.where("is_last").select("page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), F.when(own, F.col("digest_so_far")).otherwise(F.col("declared_digest")).alias("payload_digest"), "record_type", "refers_to", "url", (F.col("chunk_no") + 1).alias("n_chunks"))


def assemble(chunks: DataFrame) -> DataFrame:
    """Whole payloads of responses from their chunks, for records small enough to be a row: page_id, payload."""
    rows = chunks.where("record_type = 'response'").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "payload"))).alias("c"))
    return rows.select("page_id", F.expr("aggregate(c, cast('' as binary), (z, x) -> concat(z, x.payload))").alias("payload"))


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE octet_length(payload) >= 100 GROUP BY d)
SELECT page_id, octet_length(payload) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
