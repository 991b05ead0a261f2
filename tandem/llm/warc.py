"""Deterministic sharded WARC archives: range-sorted, rolled by compressed size, committed by a manifest."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHARD_BYTES = 16 << 20
ROLL_BYTES = 8 << 20
BUCKETS = 1 << 16
LEVEL = 6
# fixed values: archives of the same pages are the same bytes, whenever they are written
DATE = "2000-01-01T00:00:00Z"
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")

_MANIFEST = "file string, shard bigint, part int, roll int, records bigint, bytes bigint, sha256 string"
_RECORDS = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string"


def _base32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(text: str) -> str:
    """A header value on one line."""
    return " ".join(text.split())


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n"
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(head.encode()) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


def _record_id(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, '|'.join(map(str, parts)))}>"


def _target(page_id: int | None, url: str | None) -> str:
    return _line(url or "") or f"urn:page:{page_id}"


def file_info(name: str) -> bytes:
    """The record that opens an archive; its id is made of the file's name."""
    headers = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _record_id("warcinfo", name)), ("WARC-Date", DATE), ("WARC-Filename", name)]
    return _member([*headers, ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, size: int, sha1: str, first: int | None, first_url: str | None = None) -> bytes:
    """One compressed record with headers and digests made anew; a revisit has no payload and names the response."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if first is not None else http + payload
    headers = [
        ("WARC-Type", "response" if first is None else "revisit"),
        ("WARC-Record-ID", _record_id(page_id, url, sha1)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", _target(page_id, url)),
        ("WARC-Payload-Digest", f"sha1:{_base32(sha1)}"),
        ("WARC-Block-Digest", f"sha1:{_base32(hashlib.sha1(block).hexdigest())}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("X-Page-Id", str(page_id)))
    if first is not None:
        headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        headers.append(("WARC-Refers-To", _record_id(first, first_url, sha1)))
        headers.append(("WARC-Refers-To-Target-URI", _target(first, first_url)))
        headers.append(("WARC-Refers-To-Date", DATE))
        headers.append(("X-Refers-To-Page-Id", str(first)))
    return _member(headers, block)


def _plan(pages: DataFrame) -> DataFrame:
    """``(bucket, shard, parts)``: ranges of ids that hold about ``SHARD_BYTES`` each, from exact sums over all rows.

    At most ``BUCKETS`` sums reach the driver. A bucket that alone exceeds a shard is cut by a hash of its rows, and
    the order of ids then holds within each part.
    """
    spark = pages.sparkSession
    sums = pages.groupBy("bucket").agg(F.sum(F.col("size") + 512).alias("bytes")).orderBy("bucket").collect()
    out, shard, held = [], 0, 0
    for row in sums:
        if held and held + row["bytes"] > SHARD_BYTES:
            shard, held = shard + 1, 0
        held += row["bytes"]
        out.append((row["bucket"], shard, max(1, -(-row["bytes"] // SHARD_BYTES))))
    return spark.createDataFrame(out, "bucket bigint, shard bigint, parts bigint")


def write(pages: DataFrame, folder: str, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row below ``folder`` and returns the manifest, which is also stored there as ``manifest``.

    Rows are sorted by id within shards of id ranges, and a shard rolls to a new file by compressed size. A file is
    written under a temporary name and then moved to its own, and counts only once the manifest lists it; a repeated
    task writes the same bytes under the same name. Of rows with equal payloads of at least ``min_bytes`` that with the
    smallest id is the response and the others revisit it; rows that repeat the smallest id, and rows without an
    id, are responses. Null html is empty, a null url becomes a name made of the id, other columns are ignored.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    edge = rows.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi")).first()
    lo, hi = edge["lo"] or 0, edge["hi"] or 0
    width = -(-(hi - lo + 1) // BUCKETS)
    rows = rows.withColumn("bucket", F.coalesce(F.expr(f"(page_id - {lo}L) div {width}L"), F.lit(-1).cast("bigint")))
    plan = _plan(rows)
    firsts = rows.filter((F.col("size") >= min_bytes) & F.col("page_id").isNotNull()).groupBy("sha")
    firsts = firsts.agg(F.min(F.struct("page_id", "url")).alias("head"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    firsts = firsts.select("sha", F.col("head.page_id").alias("first"), F.col("head.url").alias("first_url"))
    rows = rows.join(F.broadcast(plan), "bucket")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("page_id", "sha", "url"), F.col("parts")).cast("int"))
    # payloads move once, to their file; that a row is a revisit is told by a mark that is sorted in before it
    repeats = rows.filter(F.col("size") >= min_bytes).drop("payload", "url").join(firsts, "sha").filter("page_id > first")
    marks = repeats.select("shard", "part", "page_id", "sha", "first", "first_url")
    shards = max(1, rows.sparkSession.sparkContext.defaultParallelism, plan.agg(F.sum("parts")).first()[0] or 1)
    both = rows.select("shard", "part", "page_id", "sha", "url", "payload", "size").unionByName(marks, allowMissingColumns=True)
    order = ("shard", "part", "page_id", "sha", F.col("first").isNull(), "url")
    ordered = both.repartitionByRange(shards, "shard", "part").sortWithinPartitions(*order)
    target, base = fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    target.create_dir(f"{base}/archives", recursive=True)
    target.create_dir(f"{base}/_temporary", recursive=True)

    def files(batches) -> Iterator[pa.RecordBatch]:
        store, key, roll, held, count = None, None, 0, [], 0

        def name_of(key, roll: int) -> str:
            return f"{key[0]:08d}-{key[1]:05d}-{roll:05d}.warc.gz"

        def commit() -> pa.RecordBatch:
            name = name_of(key, roll)
            data = b"".join(held)
            temporary = f"{base}/_temporary/{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(temporary) as out:
                out.write(data)
            store.move(temporary, f"{base}/archives/{name}")
            values = [name, key[0], key[1], roll, count, len(data), hashlib.sha256(data).hexdigest()]
            types = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            columns = ["file", "shard", "part", "roll", "records", "bytes", "sha256"]
            return pa.record_batch([pa.array([v], t) for v, t in zip(values, types, strict=True)], columns)

        size, mark = 0, None
        for batch in batches:
            store = store or fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")[0]
            for row in batch.to_pylist():
                if row["first"] is not None:
                    mark = row
                    continue
                again = mark is not None and (mark["page_id"], mark["sha"]) == (row["page_id"], row["sha"])
                seen = (mark["first"], mark["first_url"]) if again else (None, None)
                if (row["shard"], row["part"]) != key or size >= ROLL_BYTES:
                    if count:
                        yield commit()
                    roll = roll + 1 if (row["shard"], row["part"]) == key else 0
                    key, held, count, size = (row["shard"], row["part"]), [], 0, 0
                    held.append(file_info(name_of(key, roll)))
                held.append(record(row["page_id"], row["url"], row["payload"], row["size"], row["sha"], *seen))
                count += 1
                size += len(held[-1])
        if count:
            yield commit()

    ordered.mapInArrow(files, _MANIFEST).write.parquet(f"{folder}/manifest")
    # what failed attempts left; an attempt that still runs can only write what is there already
    target.delete_dir(f"{base}/_temporary")
    return rows.sparkSession.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _members(stream) -> Iterator[bytes]:
    """The records of an archive one after another, without reading it whole."""
    unpack, out = zlib.decompressobj(31), []
    while data := stream.read(1 << 20):
        while data:
            out.append(unpack.decompress(data))
            if not unpack.eof:
                break
            yield b"".join(out)
            data, unpack, out = unpack.unused_data, zlib.decompressobj(31), []
    if out and any(out):
        raise ValueError("the archive ends within a record")


def _headers(lines: bytes) -> dict[str, str]:
    pairs = (line.split(": ", 1) for line in lines.decode().split("\r\n")[1:])
    return {p[0].lower(): p[1] for p in pairs if len(p) == 2}


def read(spark: SparkSession, folder: str) -> DataFrame:
    """One row per page record of the archives that the manifest lists, with the payload of a response checked.

    Columns ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to`` and ``url``.
    """
    listed = spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest").select("file")
    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("file").to_pylist():
                store, base = fs.FileSystem.from_uri(uri)
                out = []
                with store.open_input_stream(f"{base}/archives/{name}", compression=None) as stream:
                    for member in _members(stream):
                        head, _, rest = member.partition(b"\r\n\r\n")
                        warc = _headers(head)
                        if "warc-payload-digest" not in warc:
                            continue
                        block = rest[: int(warc["content-length"])]
                        top, _, payload = block.partition(b"\r\n\r\n")
                        digest = warc["warc-payload-digest"].removeprefix("sha1:")
                        if warc["warc-type"] == "response" and _base32(hashlib.sha1(payload).hexdigest()) != digest:
                            raise ValueError(f"payload of {warc['warc-record-id']} does not fit its digest")
                        number = lambda k, w=warc: int(w[k]) if k in w else None
                        size = int(_headers(top)["content-length"])
                        out.append((number("x-page-id"), size, digest, warc["warc-type"], number("x-refers-to-page-id"), warc["warc-target-uri"]))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                columns = zip(*out, strict=True)
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    files = max(1, spark.sparkContext.defaultParallelism * 2)
    return listed.repartition(files, "file").mapInArrow(rows, _RECORDS)
