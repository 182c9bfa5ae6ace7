"""Deterministic sharded WARC writer and reader (operator 13).

Records are range-sorted by page and compressed one by one (a gzip member each);
a record's place in the whole sequence of compressed bytes, a prefix sum over the partitions,
says which file it belongs to, so files roll by compressed size and hold the same
bytes however Spark partitions the work.  Headers, record ids and digests are
made anew from the page.  A task writes its file under a temporary name; the
manifest (Parquet, a row for each file) lists what was written, the files then get
their final names, and a marker file comes last.  Files of lost or repeated attempts are in no
manifest.  Readers go by the manifest, a file each, and check every digest.

Of records with equal payloads of ``min_payload`` bytes or more, the one with the
largest page id is the response and the others revisit it.

Null and odd input: null html is an empty payload.  A null url gets the target
``urn:page:<id>``; control characters, blanks and non-ASCII of a url are percent-encoded.
A null page id comes last in the files and is the largest only among nulls.  Rows of one
page id with equal payloads: the first in order of the url is the response.  Extra columns are
ignored.  An empty table gives a manifest without files and no rows.  A payload goes through memory whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.joins import fits, join_small
from .common import shared_folder, written

#: Fixed value: the date of every record, so that equal pages give equal archives.
CAPTURED = "2024-01-01T00:00:00Z"
URL_SAFE = "".join(chr(c) for c in range(33, 127))
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:dealflow:warc")
#: Rows of one duplicated payload are dealt to so many tasks.
SALTS = 16
LEVEL = 6
MANIFEST = "shard bigint, file string, temporary string, records bigint, bytes bigint, sha1 string"
FOUND = [("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
         ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())]
FOUND_SCHEMA = ("page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                "file string, offset bigint")


# -- bytes of one record --------------------------------------------------

def target(page_id: int | None, url: str | None) -> str:
    return quote(url, safe=URL_SAFE) if url else f"urn:page:{'' if page_id is None else page_id}"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}:{digest}')}>"


def base32(digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: named fields, then the HTTP response (of a revisit its head only), then two line ends."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)),
              ("WARC-Date", CAPTURED), ("WARC-Target-URI", target(page_id, url)),
              ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", base32(digest))]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(refers_to, digest))]
        if refers_to is not None:
            fields.append(("Refers-To-Page-ID", str(refers_to)))
    else:
        block += payload
    fields += [("WARC-Block-Digest", base32(hashlib.sha1(block).hexdigest())), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without name or time, so that equal records give equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def info_record(shard: int) -> bytes:
    block = b"format: WARC File Format 1.1\r\n"
    return (f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, f'info:{shard}')}>\r\nWARC-Date: {CAPTURED}\r\n"
            f"WARC-Filename: {file_name(shard)}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


def file_name(shard: int) -> str:
    return f"pages-{shard:08d}.warc.gz"


def members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member; holds one member at a time."""
    at, rest = 0, b""
    while True:
        unpacker, parts, used = zlib.decompressobj(31), [], 0
        while not unpacker.eof:
            data = rest or stream.read(chunk)
            rest = b""
            if not data:
                if used:
                    raise ValueError(f"the archive ends within the record at {at}")
                return
            used += len(data)
            parts.append(unpacker.decompress(data))
        rest = unpacker.unused_data
        used -= len(rest)
        yield at, b"".join(parts)
        at += used


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower-case) and block of a record, lengths and block digest checked."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    size = int(fields["content-length"])
    if not version.startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"block digest of {fields.get('warc-record-id')} differs")
    return fields, block


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a shared folder (a local path, or file:, hdfs:, s3: or gs:)."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[len("file:"):].lstrip("/")
    return fs.FileSystem.from_uri(folder)


# -- which records are revisits --------------------------------------------

def records(pages: DataFrame, min_payload: int = 1000) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and the largest page id of equal payloads (null: stands alone)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("bigint"), "payload_digest": F.sha1("payload")})
    # one row for each payload that occurs more than once, counted in every partition first
    several = (rows.filter(F.col("payload_bytes") >= min_payload).groupBy("payload_digest")
               .agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).filter("n > 1")
               .select(F.col("payload_digest").alias("of_digest"), "largest"))
    several = written(several, "warc-payloads")
    match = F.col("payload_digest") == F.col("of_digest")
    if fits(several, 100_000):
        joined = rows.join(F.broadcast(several), match, "left")
    else:
        # a payload may make up a third of all pages: its rows are dealt out by a hash of the page
        spread = several.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")) \
            .join(spread, match & (F.col("salt") == F.col("of_salt")), "left")
    return joined.select("page_id", "url", "payload", "payload_digest", F.col("of_digest").isNotNull().alias("repeated"), "largest")


# -- writer -----------------------------------------------------------------

def _in_batches(rows: Iterator[tuple], fields: list[tuple[str, pa.DataType]], sized: int, max_bytes: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches of rows, cut where the bytes in the field number ``sized`` reach ``max_bytes``."""
    held: list[tuple] = []
    weight = 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*held), fields)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        weight += len(row[sized] or b"")
        if weight >= max_bytes or len(held) >= 4096:
            yield batch()
            held, weight = [], 0
    if held:
        yield batch()


def _compressed(rows: DataFrame) -> DataFrame:
    """part, start, member: compressed records in ascending page order, and the bytes before each in its partition."""
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, start, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            page_ids, digests, repeated, largest = (batch.column(n).to_pylist() for n in ("page_id", "payload_digest", "repeated", "largest"))
            for i, (url, payload) in enumerate(zip(batch.column("url"), batch.column("payload"))):
                key = page_ids[i], digests[i]
                # rows of one page with one payload lie together: the first is the response
                revisit = repeated[i] and (key[0] != largest[i] or before == key)
                before = key
                data = member(record(key[0], url.as_py(), payload.as_py(), key[1], largest[i], revisit))
                yield part, start, data
                start += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _in_batches(packed(batches), [("part", pa.int32()), ("start", pa.int64()), ("member", pa.binary())], 2)

    order = [F.asc_nulls_last("page_id"), F.asc("payload_digest"), F.asc_nulls_last("url")]
    return written(rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order).mapInArrow(run, "part int, start bigint, member binary"),
                   "warc-members")


def _sharded(packed: DataFrame, roll_bytes: int) -> DataFrame:
    """shard, start, member, a range partition for each shard: a record belongs to the file in whose span of all compressed bytes it begins."""
    # a row for each partition, with the bytes of earlier ones
    parts = packed.groupBy("part").agg(F.max(F.col("start") + F.octet_length("member")).alias("held"))
    total = parts.agg(F.sum("held").alias("n")).first()["n"] or 0
    parts = parts.select("part", (F.sum("held").over(Window.orderBy("part")) - F.col("held")).alias("earlier"))
    start = F.col("earlier") + F.col("start")
    placed = join_small(packed, parts, "part").select(F.floor(start / roll_bytes).cast("bigint").alias("shard"), start.alias("start"), "member")
    return placed.repartitionByRange(total // roll_bytes + 1, "shard").sortWithinPartitions("shard", "start")


def write_warc(pages: DataFrame, folder: str, min_payload: int = 1000, roll_bytes: int = 8 << 20) -> None:
    """Write the archives and their manifest to ``folder`` (which must not exist).

    A file holds the records that begin within a span of ``roll_bytes`` compressed bytes.
    """
    spark = pages.sparkSession

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(f"{root}/temporary", recursive=True)
        out, state = None, {}

        def finish() -> pa.RecordBatch:
            out.close()
            row = state | {"sha1": state["sha1"].hexdigest()}
            return pa.RecordBatch.from_pylist([row])

        def put(data: bytes) -> None:
            out.write(data)
            state["bytes"] += len(data)
            state["sha1"].update(data)

        for batch in batches:
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("member")):
                if shard != state.get("shard"):
                    if out is not None:
                        yield finish()
                    state = {"shard": shard, "file": file_name(shard), "temporary": f"temporary/{uuid.uuid4().hex}", "records": 0, "bytes": 0,
                             "sha1": hashlib.sha1()}
                    out = system.open_output_stream(f"{root}/{state['temporary']}")
                    put(member(info_record(shard)))
                put(data.as_py())
                state["records"] += 1
        if out is not None:
            yield finish()

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                final, temporary = f"{root}/{row['file']}", f"{root}/{row['temporary']}"
                # a repeated attempt finds the file in its place
                if system.get_file_info(temporary).type != fs.FileType.NotFound:
                    system.move(temporary, final)
                if system.get_file_info(final).size != row["bytes"]:
                    raise OSError(f"{row['file']} has not the size its manifest names")
            yield batch.select(["file"])

    files = _sharded(_compressed(records(pages, min_payload)), roll_bytes)
    files.select("shard", "member").mapInArrow(store, MANIFEST).write.parquet(f"{folder}/manifest")
    read_manifest(spark, folder).mapInArrow(rename, "file string").agg(F.count(F.lit(1)).alias("n_files")).write.json(f"{folder}/committed")


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each file."""
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


# -- reader -----------------------------------------------------------------

def read_warc(spark: SparkSession, folder: str, payloads: bool = True) -> DataFrame:
    """The records of the files that the manifest names, a file at a time, with every digest checked.

    url is the record's target, payload_digest hexadecimal; payload is null for
    revisits (whose size and digest are those of the full payload), or for all rows without ``payloads``.
    """
    def found(names: list[str]) -> Iterator[tuple]:
        system, root = _open(folder)
        for name in names:
            with system.open_input_stream(f"{root}/{name}", compression=None) as stream:
                for offset, data in members(stream):
                    fields, block = parse(data)
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    response = fields["warc-type"] == "response"
                    if response and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload digest of {fields['warc-record-id']} differs")
                    size = next(int(line.split(b":")[1]) for line in head.split(b"\r\n") if line.lower().startswith(b"content-length:"))
                    page, refers = fields.get("page-id"), fields.get("refers-to-page-id")
                    yield (None if page is None else int(page), fields["warc-target-uri"], payload if payloads and response else None, size,
                           digest, fields["warc-type"], None if refers is None else int(refers), name, offset)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _in_batches(found(batch.column("file").to_pylist()), FOUND, 2)

    marker = spark.read.schema("n_files bigint").json(f"{folder}/committed").first()
    if marker is None:
        raise OSError(f"{folder} holds no committed archives")
    # a task for each file, which no byte-sized merging undoes
    files = read_manifest(spark, folder).repartitionByRange(max(1, marker["n_files"]), "shard")
    return files.select("file").mapInArrow(run, FOUND_SCHEMA)


def round_trip(pages: DataFrame, min_payload: int = 1000, roll_bytes: int = 8 << 20, folder: str | None = None) -> DataFrame:
    """Write the archives (to a new shared folder unless one is given) and return what they say of each page."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, min_payload, roll_bytes)
    return read_warc(pages.sparkSession, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH rows AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
kept AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM rows)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM kept
"""
