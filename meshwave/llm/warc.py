"""WARC archives: a writer with revisit records for repeated payloads, and a splittable reader.

A record is a gzip member of its own. A reading task owns the byte range [start, end) of an archive: it looks for the gzip magic,
accepts a place as a member only if what it inflates to begins with a WARC version line, and reads every record that starts in its
range, past the range's end if need be. It looks from BACK bytes before its range on, and follows members from one end to the next: so
a member inside a record's data is not taken for a record, unless that data covers all of those bytes. Archives lie in a folder that
all executors see.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshwave.llm.common import id_filter, keep_track, maybe_in, partitions, scratch_dir, stage_table

MIN_REVISIT = 100
SPLIT = 8 << 20
SALT = 32
RANGES = 8
MAGIC = b"\x1f\x8b\x08"
#: Bytes before a range from which its first record is looked for.
BACK = 1 << 20
#: Bytes after which a task goes on with another archive.
ARCHIVE = 1 << 30
_WINDOW = 1 << 20


def _open(path: str, mode: str):
    """A local file for plain paths and file:, else a file of the store that the path's scheme names."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    if "://" not in path:
        return open(path, mode)
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner) if "r" in mode else store.open_output_stream(inner)


def _publish(temporary: str, path: str) -> None:
    if path.startswith("file:"):
        temporary, path = ("/" + p[5:].lstrip("/") for p in (temporary, path))
    if "://" not in path:
        import os

        os.replace(temporary, path)
        return
    from pyarrow import fs

    store, a = fs.FileSystem.from_uri(temporary)
    store.move(a, fs.FileSystem.from_uri(path)[1])


def _clean(value: object) -> str:
    """A header value: one line."""
    return " ".join(str(value).split())


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One gzip member with a WARC record; a revisit has no block."""
    block = payload if kind == "response" else b""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_clean(url or '')}", "WARC-Date: 2024-01-01T00:00:00Z", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {size}"]
    if kind == "revisit":
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/octet-stream", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def mark_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, size, refers_to (null for responses). Of equal payloads of at least min_bytes the smallest page_id is
    the response; rows that share that id are all responses. Null ids never win; a group of null ids alone has responses only.

    Empty and null html are payloads of no bytes; long ones are taken whole; equal rows get a record each; an empty table gives none.
    Digests are counted before the shuffle. Pages whose digest stands alone, but for few that a Bloom filter cannot tell, are not shuffled;
    the others are spread over SALT keys a digest.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")
    ).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256)).withColumn("size", F.octet_length("html").cast("long"))
    again = own.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null")
    again = stage_table(again.select("digest", "_first"), "payloads")
    names = ["page_id", "url", "html", "digest", "size"]
    maybe = maybe_in(id_filter(again.select(F.xxhash64("digest").alias("_d")).distinct(), "_d"), "_d")
    hashed = own.withColumn("_d", F.xxhash64("digest"))
    salted = hashed.where(maybe).withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int"))
    joined = salted.join(again.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["digest", "_salt"], "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.col("_first").eqNullSafe(F.col("page_id")), F.col("_first"))
    return hashed.where(~maybe).select(*names, F.lit(None).cast("long").alias("refers_to")).union(joined.select(*names, refers.alias("refers_to")))


def write_warc(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Write archives of about ARCHIVE bytes, one at least for each partition with pages; returns (path, bytes) of those, one row each. A
    task that runs again replaces its archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        total, number, out, path, temporary = 0, 0, None, "", ""

        def close():
            nonlocal out, number
            out.close()
            _publish(temporary, path)
            out, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total])], names=["path", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, size, refers_to = (c[i].as_py() for c in batch.columns)
                data = record("revisit" if refers_to is not None else "response", page_id, url, html.encode(), digest, size, refers_to)
                if out is None:
                    path, total = f"{folder}/part-{task.partitionId():06d}-{number:04d}.warc.gz", 0
                    temporary = f"{path}.{task.taskAttemptId()}.part"
                    out = _open(temporary, "wb")
                out.write(data)
                total += len(data)
                if total >= ARCHIVE:
                    yield close()
        if out:
            yield close()

    return mark_revisits(pages, min_bytes).mapInArrow(run, "path string, bytes long")


def parse_head(data: bytes) -> dict[str, str] | None:
    """The header fields of an inflated record, or None where they are not whole or not WARC."""
    end = data.find(b"\r\n\r\n")
    if not data.startswith(b"WARC/") or end < 0:
        return None
    fields = {"": str(end + 4)}
    for line in data[:end].decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields


def _begins_record(data: bytes) -> bool:
    try:
        return zlib.decompressobj(31).decompress(data, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def read_range(handle, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(place, header, block) of the records that start in [start, end). Memory: a window and one record."""
    at, data = max(0, start - BACK), b""  # data: the file's bytes from `at`
    handle.seek(at)

    def more() -> bool:
        nonlocal data
        got = handle.read(_WINDOW)
        data += got
        return bool(got)

    while at < end:
        i = data.find(MAGIC)
        if i < 0:
            keep = data[-2:] if len(data) > 2 else data
            at += len(data) - len(keep)
            data = keep
            if not more():
                return
            continue
        data, at = data[i:], at + i
        if at >= end:
            return
        while len(data) < 4096 and more():
            pass
        if not _begins_record(data[:4096]):
            data, at = data[1:], at + 1
            continue
        z, parts, feed = zlib.decompressobj(31), [], data
        used = 0
        try:
            while True:
                parts.append(z.decompress(feed))
                used += len(feed)
                if z.eof:
                    break
                feed = handle.read(_WINDOW)
                if not feed:
                    raise zlib.error("cut off")
        except zlib.error:
            if used > len(data):  # the window has moved on: go back to just behind this place
                handle.seek(at + 1)
                data = b""
            else:
                data = data[1:]
            at += 1
            continue
        rest = z.unused_data
        place, at, data = at, at + used - len(rest), rest
        if place < start:
            continue
        whole = b"".join(parts)
        head = parse_head(whole)
        if head is None:
            continue
        first = int(head[""])
        yield place, head, whole[first : first + int(head.get("content-length", 0))]


def splits(spark: SparkSession, archives: DataFrame, split: int = SPLIT) -> DataFrame:
    """path, start, end: byte ranges of at most `split` bytes over all archives, dealt evenly."""
    size = F.lit(split).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, size)).alias("start")
    return archives.where("bytes > 0").select("path", "bytes", starts).select("path", "start", F.least(F.col("start") + size, "bytes").alias("end"))


RECORDS = "path string, place long, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_warc(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """One row for each record of the ranges (path, start, end). Digest and length of a response come from the payload read; a digest
    that differs from the header's raises. Of a revisit they are the header's, and its payload is null."""

    def id_of(value: str | None) -> int | None:
        found = (value or "").strip("<>").rpartition(":")[2]
        return int(found) if found and found != "None" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("place", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        rows: list[tuple] = []
        held = 0

        def flush():
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with _open(path, "rb") as handle:
                    for place, head, block in read_range(handle, start, end):
                        kind = head["warc-type"]
                        digest = head["warc-payload-digest"].rpartition(":")[2]
                        size = int(head["warc-payload-length"])
                        if kind == "response":
                            size, got = len(block), hashlib.sha256(block).hexdigest()
                            if got != digest:
                                raise ValueError(f"{path} at {place}: the payload does not match its digest")
                        rows.append((path, place, id_of(head["warc-record-id"]), head.get("warc-target-uri"), kind, id_of(head.get("warc-refers-to")), size, digest, block if payloads and kind == "response" else None))
                        held += len(block) if payloads else 200
                        if held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    return ranges.select("path", "start", "end").mapInArrow(run, RECORDS)


def make_folder(spark: SparkSession, name: str) -> str:
    """A new folder beside the staged tables, deleted with them."""
    folder = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    keep_track(folder)
    return folder


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT, split: int = SPLIT) -> DataFrame:
    """Write the pages (page_id, url, html) to archives in the shared folder and read those back by byte ranges, without payloads: a row
    for each page. Nulls, empty and long html, equal rows and ties as mark_revisits says; an empty table gives none; other columns are not
    read. Ranges are dealt to at most RANGES * spark.sql.shuffle.partitions tasks, several to each."""
    spark = pages.sparkSession
    archives = stage_table(write_warc(pages, make_folder(spark, "warc"), min_bytes), "archives")
    ranges = splits(spark, archives, split)
    count = archives.agg(F.sum(F.ceil(F.col("bytes") / split))).first()[0] or 1
    return read_warc(ranges.repartition(int(min(count, RANGES * partitions(spark)))), payloads=False)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    read = round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, cast(strlen(h) as bigint) as payload_bytes, sha256(h) as payload_digest from p),
f as (select payload_digest, min(page_id) as low from d where payload_bytes >= 100 group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
       case when f.low is null or f.low = d.page_id then 'response' else 'revisit' end as record_type,
       case when f.low <> d.page_id then f.low end as refers_to
from d left join f on f.payload_digest = d.payload_digest
"""
