"""WARC archives with revisit records and a two-level capture index.

Writing: pages that share a payload of at least ``LEAST`` bytes have one response, that of the largest page id; the others
are revisits of it, with the HTTP header of the capture and no payload. Each task writes files of its own, a gzip member for
each record; only files that a finished task reports are in the manifest, so a lost or repeated task leaves no trace.

Index: the captures, sorted by reversed-host URL key, are cut into blocks of ``BLOCK`` lines, each compressed; a sparse
directory keeps the first key and the place of each block. A look-up finds the block in the directory and the line in the
block by binary search, then reads the record's range.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import BATCH_BYTES, Scratch, bounded_batches

LEAST = 1000
BLOCK = 1000
FILE_BYTES = 256 << 20
LEVEL = 3
CRLF = b"\r\n"
SOFTWARE = "graphloom"
WHEN = "2020-01-01T00:00:00Z"


def _files(path: str):
    """File system and local path of a URI, as executors see it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")


def surt(url: str | None) -> str:
    """Key of a URL: reversed host, port, path and query; no scheme and fragment. Null: empty."""
    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").rstrip("."), parts.port
    except ValueError:
        return (url or "").strip()
    key = ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (parts.path or "/")
    return (key + (f"?{parts.query}" if parts.query else "")) if host else (url or "").strip()


def _uri(url: str) -> str:
    return url.replace("\r", "%0D").replace("\n", "%0A")


def _name(*parts) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def _member(lines: list[str], block: bytes) -> bytes:
    """One gzip member: a record of these header lines and this block."""
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"]).encode() + CRLF + CRLF + block + CRLF + CRLF) + pack.flush()


def info(file: str) -> bytes:
    """The first record of a file."""
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: {_name('info', file)}", f"WARC-Date: {WHEN}", f"WARC-Filename: {file}", "Content-Type: application/warc-fields"], f"software: {SOFTWARE}\r\nformat: WARC File Format 1.1\r\n".encode())


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, refers_url: str | None, revisit: bool, place: str) -> bytes:
    """One compressed record. Null ids and URLs have no header line. A response's name is made of id, URL and digest, so that revisits can
    give it (rows that repeat in all three share it); a revisit's of its ``place`` in the files."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    name = _name(place) if revisit else _name(page_id, url, digest)
    lines = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {WHEN}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append("WARC-Target-URI: " + _uri(url))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to, refers_url, digest)}", f"WARC-Refers-To-Date: {WHEN}", f"X-Refers-To-Page-Id: {refers_to}"]
        if refers_url is not None:
            lines.append("WARC-Refers-To-Target-URI: " + _uri(refers_url))
    return _member(lines, http if revisit else http + payload)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC header, HTTP header and payload of one compressed record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = lambda text: dict(line.split(": ", 1) for line in text.decode().split("\r\n")[1:])
    warc = fields(head)
    http, _, payload = rest[: int(warc["Content-Length"])].partition(CRLF + CRLF)
    return warc, fields(http), payload


MANIFEST = "surt string, page_id long, url string, file string, offset long, length long"


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _files(folder)
        out = name = None
        at = number = 0
        task = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}"
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, number = f"pages-{task}-{number}.warc.gz", number + 1
                    out, first = files.open_output_stream(f"{top}/{name}", compression=None), info(name)
                    out.write(first)
                    at = len(first)
                member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["size"], r["refers_to"], r["refers_url"], r["revisit"], f"{name}|{at}")
                out.write(member)
                rows.append({"surt": surt(r["url"]), "page_id": r["page_id"], "url": r["url"], "file": name, "offset": at, "length": len(member)})
                at += len(member)
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("surt", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        if out is not None:
            out.close()

    return run


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _files(folder)
        name = f"index-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:12]}.cdx.gz"
        out, at, rows, held = None, 0, [], []

        def close_block() -> None:
            nonlocal out, at
            if out is None:
                out = files.open_output_stream(f"{top}/{name}", compression=None)
            pack = zlib.compressobj(6, zlib.DEFLATED, 31)
            data = pack.compress("\n".join(json.dumps(x) for x in held).encode()) + pack.flush()
            out.write(data)
            rows.append({"first_key": held[0][0], "file": name, "offset": at, "length": len(data), "lines": len(held)})
            at += len(data)
            held.clear()

        for batch in batches:
            for r in batch.to_pylist():
                held.append([r["surt"], r["page_id"], r["url"], r["file"], r["offset"], r["length"]])
                if len(held) == BLOCK:
                    close_block()
        if held:
            close_block()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("first_key", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())]))

    return run


def write_archive(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write archives and index to ``folder`` (a URI that all executors reach); returns the directory, also in ``folder``.

    A file begins with a warcinfo record. Groups of equal payloads are found over digests alone and written, so that pages meet them
    in a broadcast while they are few, and in a shuffle of payloads only beyond Spark's threshold.

    Null html is an empty payload. Payloads are equal if their SHA-1, a second hash and their length are. Of equal long
    payloads a null id counts only if all are null, and then each is a response; so are rows repeated with the largest id.
    An empty table gives an index without blocks; other columns are not read.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "warc-manifest")
    p = F.coalesce(pages[html], F.lit(""))
    own = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].alias("url"), p.cast("binary").alias("payload"), F.sha1(p).alias("digest"), F.xxhash64(p).alias("hash"), F.octet_length(p).cast("long").alias("size"))
    long_ = own.where(F.col("size") >= LEAST).groupBy(F.col("digest").alias("d"), F.col("hash").alias("h"), F.col("size").alias("s")).agg(F.max(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("x"), F.count(F.lit(1)).alias("n")).where("n > 1")
    long_ = scratch.table(long_.select("d", "h", "s", F.col("x.page_id").alias("last"), F.col("x.url").alias("last_url")), "groups")
    same = (F.col("digest") == F.col("d")) & (F.col("hash") == F.col("h")) & (F.col("size") == F.col("s"))
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    rows = own.join(long_, same, "left").select("page_id", "url", "payload", "digest", "size", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"), F.col("last_url").alias("refers_url"))
    rows = rows.withColumn("payload", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")))
    _make(spark, folder)
    manifest = scratch.table(rows.mapInArrow(_writer(folder), MANIFEST), "manifest")
    key = [F.col("surt"), F.col("page_id").asc_nulls_first(), F.col("file"), F.col("offset")]
    lines = manifest.repartitionByRange(*key).sortWithinPartitions(*key)
    lines.mapInArrow(_indexer(folder), "first_key string, file string, offset long, length long, lines long").write.mode("overwrite").parquet(f"{folder}/directory")
    scratch.close()
    return directory(spark, folder)


def _make(spark: SparkSession, folder: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("first_key string, file string, offset long, length long, lines long").parquet(f"{folder}/directory")


def _range(files, path: str, offset: int, length: int) -> bytes:
    with files.open_input_file(path) as source:
        source.seek(offset)
        return source.read(length)


def _lines(files, top: str, block: dict) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(_range(files, f"{top}/{block['file']}", block["offset"], block["length"]), 31).decode().split("\n")]


def look_up(spark: SparkSession, folder: str, url: str) -> list[tuple[dict, dict, bytes]]:
    """All captures of a URL. Reads the directory's rows around its key, then blocks and records by range."""
    key, rows = surt(url), directory(spark, folder)
    before = rows.where(F.col("first_key") < key).orderBy(F.desc("first_key"), F.desc("file"), F.desc("offset")).limit(1).collect()
    blocks = [*before, *rows.where(F.col("first_key") == key).orderBy("file", "offset").collect()]  # blocks of one key: its captures
    files, top = _files(folder)
    out = []
    for block in blocks:
        lines = _lines(files, top, block.asDict())
        at = bisect.bisect_left(lines, key, key=lambda x: x[0])
        for line in lines[at : bisect.bisect_right(lines, key, key=lambda x: x[0])]:
            out.append(parse(_range(files, f"{top}/{line[3]}", line[4], line[5])))
    return out


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Every capture, through the index: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for
    revisits). Digest and length of a response are those of the payload that is read, of a revisit those in its headers. Rows go on by bytes: a task holds about 4 MB of payloads, or one that is longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = _files(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for block in batch.to_pylist():
                by_file: dict[str, list] = {}
                for line in _lines(files, top, block):
                    by_file.setdefault(line[3], []).append(line)
                rows, held = [], 0
                for name, own in by_file.items():
                    with files.open_input_file(f"{top}/{name}") as source:
                        for line in sorted(own, key=lambda x: x[4]):
                            source.seek(line[4])
                            warc, http, payload = parse(source.read(line[5]))
                            again = warc["WARC-Type"] == "revisit"
                            rows.append({
                                "page_id": number(warc.get("X-Page-Id")), "url": warc.get("WARC-Target-URI"), "record_type": warc["WARC-Type"], "refers_to": number(warc.get("X-Refers-To-Page-Id")),
                                "payload_bytes": int(http["Content-Length"]) if again else len(payload), "payload_digest": warc["WARC-Payload-Digest"].removeprefix("sha1:") if again else hashlib.sha1(payload).hexdigest(), "payload": None if again else payload,
                            })
                            held += len(payload)
                            if held > BATCH_BYTES or len(rows) >= 1000:
                                yield pa.RecordBatch.from_pylist(rows, schema)
                                rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    blocks = directory(spark, folder)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return blocks.repartition(n, "file", "offset").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def op10_warc(pages: DataFrame) -> DataFrame:
    folder = posixpath.join(Scratch(pages.sparkSession, "warc").base, "archive")
    write_archive(pages, folder)
    return read_archive(pages.sparkSession, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes, t, sha1(t) AS payload_digest FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY t) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= 1000 AND last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to FROM g
"""
