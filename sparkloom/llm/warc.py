"""A deterministic sharded WARC writer, and the reader of its archives.

Writing goes through these steps:

1. Narrow rows (key, payload digest, length) tell which record of equal
   payloads is the response (that with the largest key) and which revisit it.
2. The same rows, sorted by key over range partitions, give the keys at which
   shards begin: shards hold equal shares of the payload bytes.  They follow
   from the data alone, not from how Spark sampled or split it.
3. Payload rows and revisit decisions meet in one shuffle by shard, sorted by
   key, so the payloads are shuffled once.
4. Each task writes its shards as files that roll at ``roll_bytes`` of
   compressed size, one gzip member for a record, below a temporary folder of
   the attempt's own.  Headers and digests are made anew.
5. The rows that tasks return are written as a staged manifest; a second pass
   gives the files it names their final names, and renaming the manifest
   commits the archive.  A retried, doubled or lost attempt leaves files that
   no manifest names; they are deleted.

Archives are read by streaming the files of the manifest, so memory holds one
record.  Files go through ``pyarrow.fs``, which opens local, HDFS, S3 and GCS
addresses on every executor.

Defined results: a null payload is an empty one; a null key counts as the
smallest and has no key header, and such records are dealt over the shards by
their digest; rows with the same key and the same payload
are all responses if that key is the largest of the payload, else all revisit
the same record; an empty table makes an archive without files; columns
beside key, address and payload are not stored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, urlsplit

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import materialize

REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WRITTEN = "shard int, sequence int, temporary string, name string, records long, bytes long"
RECORD = "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string"


def filesystem(address: str) -> tuple[pafs.FileSystem, str]:
    """The file system of an address, and the path there."""
    if urlsplit(address).scheme in ("", "file"):
        path = urlsplit(address).path or address
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(address)


# ---------------------------------------------------------------- records


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{key}\n{digest}'.encode()).digest()[:16], version=5)}>"


def _safe(url: str | None) -> str:
    return quote(url or "about:blank", safe=":/?#[]@!$&'()*+,;=%-._~")


def record(kind: str, date: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {date}", *(f"{k}: {v}" for k, v in headers)]
    lines += [f"WARC-Block-Digest: sha1:{_digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(key: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(key, digest)), ("WARC-Target-URI", _safe(url))]
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if key is not None:
        headers.append(("X-Record-Key", str(key)))
    if not revisit:
        return record("response", date, headers, http + payload)
    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("X-Refers-To-Key", str(refers_to))]
    return record("revisit", date, headers, http)


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Stream:
    """Unpacked bytes of a file of gzip members, taken a piece at a time."""

    def __init__(self, source, piece: int = 1 << 18):
        self.source, self.piece = source, piece
        self.z, self.packed, self.plain, self.ended = zlib.decompressobj(31), b"", bytearray(), False

    def _more(self) -> bool:
        if self.z.eof:
            self.packed, self.z = self.z.unused_data, zlib.decompressobj(31)
        data = self.packed or self.source.read(self.piece)
        self.packed = b""
        if not data:
            return False
        self.plain += self.z.decompress(data)
        return True

    def until(self, mark: bytes) -> bytes | None:
        seen = 0
        while (k := self.plain.find(mark, seen)) < 0:
            seen = max(0, len(self.plain) - len(mark))
            if not self._more():
                if self.plain:
                    raise ValueError("the archive ends within a record")
                return None
        out = bytes(self.plain[:k])
        del self.plain[: k + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.plain) < n:
            if not self._more():
                raise ValueError("the archive ends within a record")
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out


def records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a packed archive."""
    stream = _Stream(source)
    while (head := stream.until(b"\r\n\r\n")) is not None:
        version, *lines = head.decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        block = stream.take(int(headers["content-length"]))
        if f"sha1:{_digest(block)}" != headers["warc-block-digest"]:
            raise ValueError(f"block digest of {headers.get('warc-record-id')} does not match")
        if stream.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield headers, block


# ---------------------------------------------------------------- writing


def revisits(narrow: DataFrame, min_bytes: int) -> DataFrame:
    """``key, digest, refers_to`` of the rows that revisit another; ``narrow`` has ``key, digest, len``."""
    groups = narrow.where(F.col("len") >= min_bytes).groupBy("digest").agg(F.max("key").alias("top"), F.count(F.lit(1)).alias("n"))
    groups = materialize(groups.where((F.col("n") > 1) & F.col("top").isNotNull()).select(F.col("digest").alias("d"), "top"), "warc-groups")
    # Both sides are tables, so adaptive execution can split a payload that a third of the rows have.
    found = narrow.join(groups, narrow["digest"] == groups["d"], "inner")
    return found.where(F.col("key").isNull() | (F.col("key") < F.col("top"))).select("key", "digest", F.col("top").alias("refers_to")).distinct()


def shard_starts(narrow: DataFrame, shard_bytes: int, min_shards: int, max_shards: int) -> np.ndarray:
    """First key of each shard but the first: at most ``max_shards`` integers."""
    total = narrow.agg(F.coalesce(F.sum(F.col("len") + 256), F.lit(0))).first()[0]
    step = int(min(max(total // max_shards + 1, 1) if total > shard_bytes * max_shards else shard_bytes, max(total // min_shards, 1)))
    keyed = narrow.where(F.col("key").isNotNull()).groupBy("key").agg(F.sum(F.col("len") + 256).alias("len"))
    parts = materialize(keyed.repartitionByRange("key").withColumn("part", F.spark_partition_id()), "warc-order")
    # One row for each range partition, of which there are at most spark.sql.shuffle.partitions.
    sums = parts.groupBy("part").agg(F.sum("len").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("ahead"))
    within = Window.partitionBy("part").orderBy("key")
    before = F.sum("len").over(within) - F.col("len") + F.col("ahead")
    placed = parts.join(F.broadcast(sums), "part").select("key", F.floor(before / F.lit(float(step))).alias("shard"))
    starts = placed.groupBy("shard").agg(F.min("key").alias("key")).where(F.col("shard") > 0).select("key")
    return np.sort(np.array([r[0] for r in starts.collect()], dtype=np.int64))


def write_archive(
    pages: DataFrame,
    path: str,
    key: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_revisit_bytes: int = 0,
    roll_bytes: int = 256 << 20,
    shard_bytes: int = 512 << 20,
    min_shards: int = 64,
    max_shards: int = 65536,
    date: str = "2000-01-01T00:00:00Z",
) -> DataFrame:
    """Write ``pages`` below ``path`` and return the manifest table."""
    spark = pages.sparkSession
    if not isinstance(pages.schema[key].dataType, T.IntegralType):
        raise TypeError(f"keys of records are whole numbers; {key} is not")
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("len", F.octet_length("payload").cast("long"))
    narrow = materialize(rows.select("key", "digest", "len"), "warc-narrow")
    decisions = revisits(narrow, min_revisit_bytes)
    starts = spark.sparkContext.broadcast(shard_starts(narrow, shard_bytes, min_shards, max_shards))

    both = decisions.select("key", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("payload"), "digest", F.lit(-1).cast("long").alias("len"), "refers_to")
    both = both.unionByName(rows.withColumn("refers_to", F.lit(None).cast("long")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(0)
            keys = np.asarray(k.fill_null(0))
            shard = np.searchsorted(starts.value, keys, "right")
            none = np.asarray(k.is_null())
            # Without a key there is no order, so these go everywhere; a decision has its record's digest.
            shard[none] = [zlib.crc32(d.encode()) % (len(starts.value) + 1) for d in b.column("digest").filter(k.is_null()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard, pa.int32())], names=[*b.schema.names, "shard"])

    placed = both.mapInArrow(place, "key long, url string, payload string, digest string, len long, refers_to long, shard int")
    count = len(starts.value) + 1
    dealt = placed.repartition(count, "shard").sortWithinPartitions("shard", F.col("key").asc_nulls_first(), "len", "digest", "url")
    base = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(base)
        folder = f"{root}/_temporary/{uuid.uuid4().hex}"
        made: list[tuple] = []
        out, shard, sequence, size, n = None, -1, 0, 0, 0
        at_key, refers = object(), {}

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                made.append((shard, sequence, temporary, name, n, size))
            out = None

        for b in batches:
            for s, k, u, p, hexa, length, to in zip(*(b.column(c).to_pylist() for c in ("shard", "key", "url", "payload", "digest", "len", "refers_to")), strict=True):
                if (s, k) != at_key:
                    at_key, refers = (s, k), {}
                if length < 0:
                    refers[hexa] = to
                    continue
                if s != shard or size >= roll_bytes:
                    close()
                    sequence = sequence + 1 if s == shard else 0
                    shard, size, n = s, 0, 0
                if out is None:
                    name = f"part-{shard:05d}-{sequence:05d}.warc.gz"
                    fs.create_dir(folder, recursive=True)
                    temporary = f"{folder}/{name}"
                    out = fs.open_output_stream(temporary, compression=None)
                    info = member(record("warcinfo", date, [("WARC-Record-ID", record_id(None, name)), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(info)
                    size += len(info)
                digest = base64.b32encode(bytes.fromhex(hexa)).decode()
                data = member(page_record(k, u, p.encode(), length, digest, refers.get(hexa), hexa in refers, date))
                out.write(data)
                size, n = size + len(data), n + 1
        close()
        columns = list(zip(*made, strict=True)) if made else [[]] * 6
        types = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["shard", "sequence", "temporary", "name", "records", "bytes"])

    staged = materialize(dealt.mapInArrow(write, WRITTEN), "warc-staged")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(base)
        fs.create_dir(f"{root}/archive", recursive=True)
        for b in batches:
            for temporary, name, size in zip(*(b.column(c).to_pylist() for c in ("temporary", "name", "bytes")), strict=True):
                final = f"{root}/archive/{name}"
                there = fs.get_file_info(final)
                if there.type == pafs.FileType.NotFound or there.size != size:
                    fs.move(temporary, final)
            yield b

    staged.mapInArrow(commit, WRITTEN).select("shard", "sequence", "name", "records", "bytes").write.parquet(f"{base}/_manifest")
    _commit(spark, base)
    return spark.read.parquet(f"{base}/manifest")


def _commit(spark: SparkSession, base: str) -> None:
    """The manifest takes its final name, and what unsuccessful attempts left goes."""
    jvm = spark.sparkContext._jvm
    to = lambda name: jvm.org.apache.hadoop.fs.Path(f"{base}/{name}")
    fs = to("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.rename(to("_manifest"), to("manifest")):
        raise OSError(f"can't commit {base}")
    fs.delete(to("_temporary"), True)


# ---------------------------------------------------------------- reading


def read_archive(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """A row for each page record of a committed archive; digests are checked while reading."""
    base = path.rstrip("/")
    files = spark.read.schema("shard int, sequence int, name string, records long, bytes long").parquet(f"{base}/manifest")
    files = files.select("name", "records")
    n = max(1, min(files.count(), 8 * spark.sparkContext.defaultParallelism))
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    kinds = [types[x.split()[1]] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(base)
        rows: list[tuple] = []
        weight = 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for b in batches:
            for name, expected in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                seen = 0
                with fs.open_input_stream(f"{root}/archive/{name}", compression=None) as source:
                    for h, block in records(source):
                        if h["warc-type"] not in ("response", "revisit"):
                            continue
                        head, _, body = block.partition(b"\r\n\r\n")
                        length = int(dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])["Content-Length"])
                        digest = h["warc-payload-digest"].removeprefix("sha1:")
                        revisit = h["warc-type"] == "revisit"
                        if not revisit and (len(body) != length or _digest(body) != digest):
                            raise ValueError(f"payload of {h['warc-record-id']} does not match its digest")
                        k, to = h.get("x-record-key"), h.get("x-refers-to-key")
                        row = (None if k is None else int(k), h["warc-target-uri"], length, digest, h["warc-type"], None if to is None else int(to), h["warc-record-id"])
                        rows.append((*row, None if revisit else body) if payloads else row)
                        seen += 1
                        weight += len(body) if payloads else 0
                        if len(rows) >= 5000 or weight >= 8 << 20:
                            yield out()
                            rows, weight = [], 0
                if seen != expected:
                    raise ValueError(f"{name} has {seen} records; the manifest says {expected}")
        if rows:
            yield out()

    return files.repartition(n).mapInArrow(read, schema)
