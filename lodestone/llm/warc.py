"""Writing pages into WARC archives deterministically, and reading archives back.

Pages are dealt into ranges of page_id whose bounds come from a sample of bounded size that is taken
by hash, so equal input gives equal ranges, one for each task; within a range they are sorted, and the
task writes one file after another, rolling when the compressed size reaches a limit. Record headers
and digests are generated anew from the payload. A file is written under a temporary name and moved to
its own when complete, unless an earlier attempt of the task has done that: it has the same bytes. It
counts once the manifest, itself written with Spark's commit, names it; then what dead attempts left
is removed. Each record is a gzip member of its own.

Of records with equal payloads of at least ``least`` bytes, the one with the largest page_id carries
the payload and the others are revisit records that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.base import bound_batches, hash_unit, join_counted, materialize, record_batch, session_folder

LEAST_BYTES = 1000
FILE_BYTES = 64 << 20
#: Payload of a range, at least; more where there would be more than RANGES of them.
RANGE_BYTES = 16 << 20
RANGES = 50_000
#: Rows of the sample for each range, on average: the driver gets RANGES times as many at most (16 MB).
SAMPLED_PER_RANGE = 20
TEMPORARY = ".tmp"
DATE = "1970-01-01T00:00:00Z"
_SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) not in "<>")


def _digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _hex(digest: str) -> str:
    return base64.b32decode(digest.removeprefix("sha1:")).hex()


def record_id(page_id: int | None, payload_digest: str, nth: int = 0) -> str:
    """Names a record; the second and later records of one page with one payload have a number."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{_hex(payload_digest)}{f':{nth}' if nth else ''}>"


def _page_of(record: str) -> int | None:
    number = record.strip("<>").split(":")[2]
    return None if number == "null" else int(number)


def _record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), *headers, ("WARC-Block-Digest", _digest(block)), ("Content-Length", str(len(block)))]
    return "WARC/1.1\r\n".encode() + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, is_revisit: bool, nth: int = 0) -> bytes:
    """A response record with HTTP headers and the payload, or a revisit record with the headers alone."""
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", record_id(page_id, digest, nth)), ("WARC-Date", DATE), ("WARC-Target-URI", quote(url, safe=_SAFE) if url else "urn:page:unknown"), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if not is_revisit:
        return _record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to, digest))]
    return _record("revisit", headers, http)


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_MANIFEST = [("file", pa.string()), ("range", pa.int64()), ("part", pa.int32()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]
_MANIFEST_DDL = "file string, range long, part int, records long, bytes long, sha256 string"


class _File:
    """One archive under its temporary name."""

    def __init__(self, store: pafs.FileSystem, root: str, number: int, part: int) -> None:
        self.store, self.root, self.range, self.part = store, root, number, part
        self.name = f"pages-{number:06d}-{part:05d}.warc.gz"
        self.temporary = f"{root}/{TEMPORARY}/{uuid.uuid4().hex}-{self.name}"
        self.out = store.open_output_stream(self.temporary, compression=None)  # members are packed here
        self.bytes = self.records = 0
        self.sum = hashlib.sha256()
        info = f"software: lodestone\r\nformat: WARC File Format 1.1\r\nisPartOf: {self.name}\r\n".encode()
        self._write(_record("warcinfo", [("WARC-Record-ID", f"<urn:warcinfo:{self.name}>"), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], info))

    def _write(self, record: bytes) -> None:
        packed = _member(record)
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)

    def add(self, record: bytes) -> None:
        self._write(record)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        final = f"{self.root}/{self.name}"
        if self.store.get_file_info(final).type == pafs.FileType.NotFound:
            self.store.move(self.temporary, final)
        else:  # of an earlier attempt: the same bytes
            self.store.delete_file(self.temporary)
        return self.name, self.range, self.part, self.records, self.bytes, self.sum.hexdigest()


def range_bounds(sizes: DataFrame, range_bytes: int, per_range: int = SAMPLED_PER_RANGE, most: int = RANGES) -> list[int]:
    """Upper bounds of all ranges but the last, from a sample by hash of (page_id, payload_bytes)."""
    total = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("payload_bytes").alias("b")).first()
    ranges = min(most, max(1, -(-int(total["b"] or 0) // range_bytes)))
    if ranges == 1:
        return []
    share = min(1.0, per_range * ranges / max(1, total["n"]))
    sample = sizes.where("page_id is not null").where(hash_unit("page_id", seed=9) < share).select("page_id", "payload_bytes").toArrow().sort_by([("page_id", "ascending"), ("payload_bytes", "ascending")])
    ids, weight = sample.column(0).to_numpy(), sample.column(1).to_numpy().astype(float) + 1
    reached = np.cumsum(weight) / weight.sum()
    return sorted({int(ids[np.searchsorted(reached, k / ranges)]) for k in range(1, ranges)}) if len(ids) else []


def _payload() -> Column:
    return F.coalesce(F.col("html").cast("string"), F.lit(""))


def write_archives(pages: DataFrame, uri: str, least: int = LEAST_BYTES, file_bytes: int = FILE_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Writes a record for each row of ``pages`` (page_id, url, html) and returns the committed manifest.

    Null html is an empty payload; null urls and ids are written as unknown, and rows without an id
    are dealt by their payload. Rows that repeat the id of a group's response are responses too. An
    empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), _payload().alias("html")).withColumn("digest", F.sha1("html"))
    meta = materialize(rows.select("page_id", "digest", F.octet_length("html").cast("long").alias("payload_bytes")), "payloads")
    large = meta.where(F.col("payload_bytes") >= least)
    groups = materialize(large.groupBy("digest").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1 and target is not null"), "copies")
    again = join_counted(large, groups, "digest", "n", meta.count()).where("page_id is null or page_id <> target").select("page_id", "digest", "target").distinct()
    found = range_bounds(meta, range_bytes)
    bounds, ranges = spark.sparkContext.broadcast(np.array(found, dtype=np.int64)), len(found) + 1

    @F.arrow_udf("int")
    def range_of(ids: pa.Array) -> pa.Array:
        numbers = ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        return pa.array(np.searchsorted(bounds.value, numbers, side="left"), pa.int32())

    none = F.lit(None).cast("string")
    marks = again.select("page_id", none.alias("url"), none.alias("html"), "digest", "target", F.lit(0).alias("kind"))
    tagged = rows.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("target"), F.lit(1).alias("kind")).unionByName(marks)
    anywhere = F.pmod(F.xxhash64("digest"), F.lit(ranges)).cast("int")
    placed = tagged.withColumn("range", F.when(F.col("page_id").isNull(), anywhere).otherwise(range_of("page_id")))
    # kind 0 comes right before the rows of its page and payload: it says that they are revisits
    dealt = placed.repartitionById(ranges, "range").sortWithinPartitions("range", "page_id", "digest", "kind", "url")
    store, root = pafs.FileSystem.from_uri(uri)
    store.create_dir(f"{root}/{TEMPORARY}", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        store.create_dir(f"{root}/{TEMPORARY}", recursive=True)
        done: list[tuple] = []
        file: _File | None = None
        now, target, nth = (), None, 0
        for batch in batches:
            for page_id, url, html, digest, refers_to, kind, number in zip(*(c.to_pylist() for c in batch.columns)):
                if (page_id, digest) != now:
                    now, target, nth = (page_id, digest), None, 0
                if kind == 0:
                    target = refers_to
                    continue
                if file is None or file.range != number or file.bytes >= file_bytes:
                    if file is not None:
                        done.append(file.commit())
                    file = _File(store, root, number, file.part + 1 if file is not None and file.range == number else 0)
                file.add(page_record(page_id, url, html.encode("utf-8"), target, target is not None, nth))
                nth += 1
        if file is not None:
            done.append(file.commit())
        if done:
            yield record_batch(_MANIFEST, **{name: [d[i] for d in done] for i, (name, _) in enumerate(_MANIFEST)})

    manifest = f"{uri}/manifest"
    dealt.mapInArrow(write, _MANIFEST_DDL).write.mode("errorifexists").parquet(manifest)
    store.delete_dir(f"{root}/{TEMPORARY}")
    return spark.read.schema(_MANIFEST_DDL).parquet(manifest)


def records_of(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream of gzip members."""
    pending = b""
    while True:
        pending = pending or stream.read(chunk)
        if not pending:
            return
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            data = pending or stream.read(chunk)
            if not data:
                raise ValueError("an archive ends within a record")
            parts.append(member.decompress(data))
            pending = b""
        pending = member.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(headers["Content-Length"])]
        if len(block) != int(headers["Content-Length"]) or _digest(block) != headers["WARC-Block-Digest"]:
            raise ValueError(f"a damaged record: {headers.get('WARC-Record-ID')}")
        yield headers, block


_READ = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]


def read_archives(manifest: DataFrame, uri: str, payloads: bool = False) -> DataFrame:
    """A row for each page record of the files that the manifest names; ``payloads`` adds url and payload (null in revisits)."""
    fields = _READ + [("url", pa.string()), ("payload", pa.binary())] * payloads

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                rows, size = [], 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in records_of(stream):
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        length = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
                        revisit = headers["WARC-Type"] == "revisit"
                        digest = _hex(headers["WARC-Payload-Digest"])
                        if not revisit and (len(body) != length or hashlib.sha1(body).hexdigest() != digest):
                            raise ValueError(f"a damaged payload: {headers['WARC-Record-ID']}")
                        row = (_page_of(headers["WARC-Record-ID"]), length, digest, headers["WARC-Type"], _page_of(headers["WARC-Refers-To"]) if revisit else None)
                        rows.append(row + (headers["WARC-Target-URI"], None if revisit else body) * payloads)
                        size += len(body) * payloads
                        if len(rows) >= 20_000 or size > 1 << 24:
                            yield record_batch(fields, **{f: [r[i] for r in rows] for i, (f, _) in enumerate(fields)})
                            rows, size = [], 0
                if rows:
                    yield record_batch(fields, **{f: [r[i] for r in rows] for i, (f, _) in enumerate(fields)})

    tasks = max(1, manifest.count())
    ddl = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    return manifest.select("file").repartition(tasks).mapInArrow(read, ddl)


def round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Writes ``pages`` into a new folder of the shared one and reads them back."""
    uri = f"{session_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_archives(write_archives(pages, uri, **options), uri)
