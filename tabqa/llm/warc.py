"""Deterministic sharded WARC archives, written and read by Spark tasks.

Writing: records are range-partitioned by page id into shards.  The cuts come from
an exact histogram of bytes over the ids, so they depend on the data alone, not on
partitions or sampling; ids that fill a cell beyond a shard's size are spread by
digest, as are rows without an id.  A task sorts its shards, writes one gzip
member per record and rolls to a new file by compressed size.  Headers and digests
are regenerated from the payload; names, ids and dates derive from the data, so a
repeated attempt writes the same bytes.  A file is written under a temporary name
and moved to its final name when complete; the manifest, a Parquet table with a
row per file written by Spark's committer, commits the archive: readers open only
the files it names.  Files go to the folder of ``spark.checkpoint.dir`` through
``pyarrow.fs``, which reaches the shared stores that Spark's executors share.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the
largest page id is a response, the others are revisits that name it.  Only slim
rows (id, digest, size) are compared; payloads are shuffled once, to their shards,
where a revisit's decision meets its record.

Defined results: null html is an empty payload, smaller than any revisit; a null url
becomes ``urn:none``; a null id is never the largest, and such rows revisit a row with
an id, if there is one; rows that repeat the largest id are all responses; an empty
table gives an archive without files; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabqa.llm.common import ship
from tabqa.session import ensure_checkpoint_dir, pin

ship(__name__)


@dataclass(frozen=True)
class WarcParams:
    shard_bytes: int = 64 << 20  # payload bytes a shard aims at
    roll_bytes: int = 32 << 20  # compressed bytes after which a file is closed
    max_cells: int = 200_000  # cells of the histogram: the bound of a broadcast
    revisit_bytes: int = 1000
    level: int = 6
    date: str = "2024-01-01T00:00:00Z"  # of all records, so that reruns agree


REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(base: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(base)


def _member(lines: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # a gzip member; zlib writes no time into it
    return z.compress(head.encode() + block + b"\r\n\r\n") + z.flush()


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(repr(parts).encode()).digest()[:16])}>"


def _uri(url: str | None) -> str:
    """A header value: controls and spaces are percent-encoded."""
    return "urn:none" if url is None else "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id: int | None, url: str | None, payload: bytes, original: int | None, copy: int, p: WarcParams) -> bytes:
    """The gzip member of a page; ``original`` is the page that a revisit names, ``copy`` numbers rows of equal id and payload."""
    digest = _sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = original is not None
    block = http if revisit else http + payload
    lines = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _urn(page_id, url, digest, copy)),
        ("WARC-Date", p.date),
        ("WARC-Target-URI", _uri(url)),
        ("WARC-Payload-Digest", digest),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        lines.append(("X-Page-ID", str(page_id)))
    if revisit:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page-ID", str(original))]
    return _member(lines, block, p.level)


class _Roller:
    """Writes members to files of a shard, one after another, each under a temporary name until it is complete."""

    def __init__(self, base: str, p: WarcParams):
        self.fs, self.root = _open(base)
        self.p, self.shard, self.number, self.out = p, None, 0, None

    def add(self, shard: int, member: bytes, page_id: int | None) -> Iterator[tuple]:
        if self.out and (shard != self.shard or self.size + len(member) > self.p.roll_bytes):
            yield self.close()
        if shard != self.shard:
            self.shard, self.number = shard, 0
        if not self.out:
            self.name = f"shard-{shard:08d}-{self.number:05d}.warc.gz"
            self.number += 1
            self.temp = f"{self.root}/tmp/{self.name}.{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.hash, self.first = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256(), page_id
            info = f"software: tabqa\r\nformat: WARC File Format 1.1\r\nisPartOf: shard-{shard:08d}\r\n".encode()
            lines = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(self.name)), ("WARC-Date", self.p.date), ("WARC-Filename", self.name)]
            self._put(_member([*lines, ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(info)))], info, self.p.level))
        self._put(member)
        self.records, self.last = self.records + 1, page_id

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.hash.update(data)
        self.size += len(data)

    def close(self) -> tuple:
        self.out.close()
        self.out = None
        self.fs.move(self.temp, f"{self.root}/{self.name}")
        return self.name, self.records, self.size, self.hash.hexdigest(), self.first, self.last


_MANIFEST = "file string, records bigint, bytes bigint, sha256 string, first_id bigint, last_id bigint"


def write(pages: DataFrame, base: str, p: WarcParams = WarcParams(), id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archive under ``base`` (a URI) and returns its manifest, a row per file."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    x = pages.select(F.col(id_col).cast("bigint").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    x = x.withColumn("digest", F.unhex(F.sha1("payload")))
    slim = pin(x.select("id", "digest", F.octet_length("payload").cast("bigint").alias("size")), "warc-sizes")

    # Cuts of the ids into cells of equal width, and of the cells into shards of equal bytes.
    span = slim.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    lo, hi, total = span["lo"] or 0, span["hi"] or 0, span["bytes"] or 0
    cells = max(1, min(p.max_cells, hi - lo + 1, 64 * (1 + total // p.shard_bytes)))
    width = -(-(hi - lo + 1) // cells)
    cell = F.when(F.col("id").isNull(), F.lit(-1)).otherwise(F.expr(f"cast((cast(id as decimal(20,0)) - {lo}) div {width} as bigint)"))
    n_shards = 1
    cuts: list[tuple[int, int, int]] = []
    filled = 0
    for r in slim.groupBy(cell.alias("cell")).agg(F.sum("size").alias("bytes")).orderBy("cell").collect():  # at most max_cells rows
        if r["bytes"] > 2 * p.shard_bytes or r["cell"] == -1:  # spread by digest over shards of its own
            own = max(1, -(-r["bytes"] // p.shard_bytes))
            first = n_shards if filled else n_shards - 1
            cuts.append((r["cell"], first, own))
            n_shards, filled = first + own + 1, 0
            continue
        if filled and filled + r["bytes"] > p.shard_bytes:
            n_shards, filled = n_shards + 1, 0
        filled += r["bytes"]
        cuts.append((r["cell"], n_shards - 1, 1))
    plan = pages.sparkSession.createDataFrame(cuts or [(0, 0, 1)], "cell bigint, first int, own int")
    spread = F.col("first") + F.pmod(F.crc32("digest"), F.col("own")).cast("int")

    largest = slim.where(F.col("size") >= p.revisit_bytes).groupBy("digest").agg(F.max("id").alias("original"), F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) & F.col("original").isNotNull())
    revisits = slim.join(largest, "digest").where(F.col("id").isNull() | (F.col("id") < F.col("original"))).select("id", "digest", "original").distinct()
    both = x.select("id", "digest", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("bigint").alias("original")).unionByName(
        revisits.select("id", "digest", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"), "original")
    )
    dealt = both.withColumn("cell", cell).join(F.broadcast(plan), "cell").withColumn("shard", spread)
    dealt = dealt.repartition(n_shards, "shard").sortWithinPartitions("shard", "id", "digest", "kind", "url")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, key, original, copy, done = _Roller(base, p), None, None, 0, []
        for b in parts:
            col = {n: b.column(n) for n in b.schema.names}
            for i in range(b.num_rows):
                id_, digest, shard = col["id"][i].as_py(), col["digest"][i].as_py(), col["shard"][i].as_py()
                if (id_, digest) != key:
                    key, original, copy = (id_, digest), None, 0
                if not col["kind"][i].as_py():
                    original = col["original"][i].as_py()
                    continue
                done += roller.add(shard, record(id_, col["url"][i].as_py(), col["payload"][i].as_py(), original, copy, p), id_)
                copy += 1
        if roller.out:
            done.append(roller.close())
        if done:
            names = ["file", "records", "bytes", "sha256", "first_id", "last_id"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)

    fs, root = _open(base)
    fs.create_dir(f"{root}/tmp", recursive=True)
    rows = dealt.select("shard", "id", "digest", "kind", "url", "payload", "original").mapInArrow(run, _MANIFEST)
    rows.write.mode("error").parquet(f"{base}/manifest")
    fs.delete_dir(f"{root}/tmp")  # what attempts that did not complete have left
    return pages.sparkSession.read.schema(_MANIFEST).parquet(f"{base}/manifest")


def records(stream, chunk: int = 1 << 20) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a gzip file, one member at a time."""
    data = b""
    while True:
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not data:
                data = stream.read(chunk)
                if not data:
                    if parts:
                        raise ValueError("a WARC file ends inside a record")
                    return
            parts.append(z.decompress(data))
            data = z.unused_data if z.eof else b""
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield lines, rest[: int(lines["Content-Length"])]


def read(manifest: DataFrame, base: str, payload: bool = False) -> DataFrame:
    """Records of an archive: ``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` (and ``payload``, null for revisits).

    The payload digest of a response is computed anew and must be that of its header.
    """
    schema = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + ", payload binary" * payload
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payload
    names = [c.split()[0] for c in schema.split(", ")]

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, body = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"]
        size = int(next(line for line in http.split(b"\r\n") if line.startswith(b"Content-Length: ")).split(b": ")[1])
        kind = head["WARC-Type"]
        if kind == "response" and (_sha1(body) != digest or len(body) != size):
            raise ValueError(f"the payload of {head['WARC-Record-ID']} is not what its header says")
        number = lambda k: int(head[k]) if k in head else None
        url = head["WARC-Target-URI"]
        out = (number("X-Page-ID"), None if url == "urn:none" else url, size, base64.b32decode(digest[5:]).hex(), kind, number("X-Refers-To-Page-ID"))
        return out + ((body if kind == "response" else None),) * payload

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(base)
        for b in parts:
            for name in b.column("file").to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        rows.append(row(head, block))
                        held += len(block) if payload else 200
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, manifest.count())
    return manifest.select("file").repartition(n, "file").mapInArrow(run, schema)


def new_folder(spark: SparkSession) -> str:
    """A fresh folder for an archive under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
