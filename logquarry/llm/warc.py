"""WARC archives: a deterministic sharded writer, and a reader.

Records are cut into shards by ranges of the page id. The borders come from a sample by hash, so they
depend on the rows alone, and carry equal bytes. A shard is sorted by page id and payload digest, and
its task streams the records into files that are rolled by compressed size; each record is a gzip
member with its headers and digests made anew. Of records with equal payloads of REVISIT_BYTES or
more, the one with the largest page id is a response, the others are revisits of it. A shard learns
of repeated payloads from one row per digest that it holds, so a payload that a third of all pages
share is one row per shard.

Tasks write under temporary names that hold the attempt, and report what they wrote; a second job
gives the reported files their final names and writes the manifest, which is the commit. A reader
takes only files that the manifest names, so a lost executor leaves nothing that is read.

Defined results: null html is an empty payload; payloads below REVISIT_BYTES are always responses.
A null page id sorts first, and is never referred to unless all records of the payload have none;
then, as for rows that repeat the largest id, each is a response. A null url is written as a name
made of the page id. Repeated rows are records each. Other columns are not written. An empty table
gives an empty manifest.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logquarry.llm import blocks as B

REVISIT_BYTES = 1000
# Payload bytes of a shard, compressed bytes after which a file is rolled.
SHARD_BYTES = 32 << 20
ROLL_BYTES = 16 << 20
# Sampled pages that place the borders of the shards.
SAMPLE = 20_000
# Bytes given to the decompressor at once.
FEED = 1 << 14
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "shard int, part int, temporary string, file string, records long, bytes long, sha256 string"
RECORDS = (
    "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
    "refers_to long, file string"
)
# Fixed value: the profile that the format names for revisits of equal payloads.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path)


def _digest(raw: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(raw).digest()).decode()


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ' '.join(map(str, parts)))}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in headers if value is not None)
    raw = f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # the gzip header has no time and no name
    return packer.compress(raw) + packer.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, target: int | None, date: str = DATE) -> bytes:
    """One compressed record; a revisit if ``target`` names the page it repeats."""
    payload_digest = _digest(payload)
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = target is not None
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page_id, payload_digest)),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", payload_digest),
        ("WARC-Block-Digest", _digest(block)),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(target, payload_digest) if revisit else None),
        ("Content-Type", "application/http;msgtype=response"),
        ("X-Page-Id", page_id),
        ("X-Refers-To-Page-Id", target),
    ]
    return _record(headers, block)


def read_records(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an archive."""
    at = 0
    while at < len(raw):
        unpacker, pieces = zlib.decompressobj(31), []
        while not unpacker.eof:  # fed in pieces: what follows the member is copied each time
            pieces.append(unpacker.decompress(raw[at : at + FEED]))
            at += min(FEED, len(raw) - at)
            if at >= len(raw) and not unpacker.eof:
                raise ValueError("the archive ends within a record")
        at -= len(unpacker.unused_data)
        record = b"".join(pieces)
        head, _, rest = record.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[: int(fields["Content-Length"])]


def _borders(pages: DataFrame) -> np.ndarray:
    """Page ids that start a new shard, so that shards carry about SHARD_BYTES."""
    rows, size = pages.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    shards = -(-size // SHARD_BYTES)
    if shards <= 1:
        return np.empty(0, np.int64)
    share = int(min(1.0, SAMPLE / rows) * (1 << 31))
    picked = pages.filter((F.pmod(F.xxhash64("page_id"), F.lit(1 << 31)) < share) & F.col("page_id").isNotNull())
    # Repeated ids come as one row, so the sample stays within its bound.
    sample = picked.groupBy("page_id").agg(F.sum("size").alias("size")).orderBy("page_id").toPandas()
    done = np.cumsum(sample["size"].to_numpy(np.float64))
    at = np.searchsorted(done, done[-1:] * np.arange(1, shards) / shards) if len(done) else np.empty(0, np.int64)
    return np.unique(sample["page_id"].to_numpy(np.int64)[at])


def write(pages: DataFrame, path: str, date: str = DATE) -> DataFrame:
    """Write ``page_id``, ``url`` and ``html`` as archives into the new folder ``path``.

    Runs at once and returns the manifest, one row per file, which is also ``path``/manifest.
    """
    spark = B.prepare(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumn(
        "size", F.octet_length("payload")
    )
    borders = _borders(known.select("page_id", "size"))
    shards = len(borders) + 1

    @F.pandas_udf("int")
    def shard_of(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, ids.to_numpy(np.int64), "right").astype(np.int32))

    shard = shard_of(F.coalesce("page_id", F.lit(-(1 << 63)))) if shards > 1 else F.lit(0)
    records = known.withColumn("shard", shard).withColumn("key", F.when(F.col("size") >= REVISIT_BYTES, F.sha2("payload", 256)))
    keyed = records.filter("key is not null").groupBy("key", "shard").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    targets = keyed.groupBy("key").agg(F.max("last").alias("target"), F.sum("n").alias("n")).filter("n > 1 and target is not null")
    repeats = keyed.join(targets.select("key", "target"), "key").select(
        "shard", F.lit(0).alias("kind"), F.col("target").alias("page_id"), F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("binary").alias("payload"), "key",
    )
    rows = repeats.unionByName(records.select("shard", F.lit(1).alias("kind"), "page_id", "url", "payload", "key"))
    placed = rows.repartitionById(shards, "shard").sortWithinPartitions("kind", "page_id", "key", "payload", "url")

    def write_shard(batches):
        context = TaskContext.get()
        store, base = _open(path)
        folder = f"{base}/_temporary"
        store.create_dir(folder, recursive=True)
        targets: dict[str, int] = {}
        out, hashed, size, records, part, done = None, None, 0, 0, 0, []

        def close(shard: int) -> None:
            out.close()
            name = f"shard-{shard:06d}-{part:05d}.warc.gz"
            done.append((shard, part, temporary, name, records, size, hashed.hexdigest()))

        last = 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("shard", "kind", "page_id", "url", "payload", "key")]
            for shard, kind, page_id, url, raw, key in zip(*columns):
                if not kind:
                    targets[key] = page_id
                    continue
                target = targets.get(key) if key else None
                blob = page_record(page_id, url, raw, None if target == page_id else target, date)
                if out is None or size and size + len(blob) > ROLL_BYTES:
                    if out is not None:
                        close(last)
                        part += 1
                    temporary = f"{shard:06d}-{part:05d}-{context.taskAttemptId()}.tmp"
                    out, hashed, size, records = store.open_output_stream(f"{folder}/{temporary}"), hashlib.sha256(), 0, 0
                out.write(blob)
                hashed.update(blob)
                size, records, last = size + len(blob), records + 1, shard
        if out is not None:
            close(last)
        yield pa.RecordBatch.from_pylist(
            [dict(zip((c.split()[0] for c in MANIFEST.split(", ")), row)) for row in done],
            pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("temporary", pa.string()), ("file", pa.string()),
                       ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]),
        )

    def commit(batches):
        store, base = _open(path)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("file").to_pylist()):
                source = f"{base}/_temporary/{temporary}"
                # A repeated task finds its files renamed already.
                if store.get_file_info(source).type != pa.fs.FileType.NotFound:
                    store.move(source, f"{base}/{name}")
            yield batch

    pending = B.written(placed.mapInArrow(write_shard, MANIFEST), "pending")
    pending.mapInArrow(commit, MANIFEST).drop("temporary").write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """All records that the manifest of ``path`` names, with their digests checked.

    A revisit has no payload of its own; its size and digest are those of the page it refers to.
    """
    B.prepare(spark)
    files = manifest(spark, path)

    def records(batches):
        for batch in batches:
            for name, raw in zip(batch.column("file").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for fields, block in read_records(raw):
                    http, _, body = block.partition(b"\r\n\r\n")
                    revisit = fields["WARC-Type"] == "revisit"
                    digest = fields["WARC-Payload-Digest"]
                    if fields["WARC-Block-Digest"] != _digest(block) or not revisit and digest != _digest(body):
                        raise ValueError(f"a digest of {fields['WARC-Record-ID']} in {name} does not fit")
                    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.startswith(b"Content-Length"))
                    ids = [int(fields[h]) if fields.get(h, "None") != "None" else None for h in ("X-Page-Id", "X-Refers-To-Page-Id")]
                    rows.append(
                        {
                            "page_id": ids[0],
                            "url": fields["WARC-Target-URI"],
                            "record_type": fields["WARC-Type"],
                            "payload": body if payload and not revisit else None,
                            "payload_bytes": size,
                            "payload_digest": base64.b32decode(digest.removeprefix("sha1:")).hex(),
                            "refers_to": ids[1],
                            "file": name,
                        }
                    )
                yield pa.RecordBatch.from_pylist(
                    rows,
                    pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                               ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string())]),
                )

    if files.isEmpty():
        return spark.createDataFrame([], RECORDS)
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    named = stored.withColumn("file", F.element_at(F.split("path", "/"), -1)).select("file", "content")
    return named.join(files.select("file"), "file", "left_semi").mapInArrow(records, RECORDS)
