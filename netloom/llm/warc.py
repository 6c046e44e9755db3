"""WARC archives with an index written first and read first.

Writing: each row becomes a record in its own gzip member. While a task writes its archive it
emits one index row per record: file, offset, length, URL, digest, kind. The index is a table in
Parquet; archives have names of their own for every attempt, so that the index holds only
those of attempts that ended well, and what a lost executor left behind is never read.

Equal payloads of at least `least_bytes` are stored once: the row with the largest id is a response, the others
are revisits that refer to it. Which rows these are is found from digests and ids alone; groups are
reduced to their largest id before anything is joined. Only payloads of rows that may be revisits, by a bitmap of a
fixed size, move to the join that decides; all others are written by the task that scans them.

Reading: choose index rows, sort them by file and offset, and fetch neighbouring records
with one read (gaps up to `gap` bytes are read too, one read holds up to `span` bytes). Reads are
dealt out by file and span to as many tasks as the chosen records' bytes call for (index rows are too small to tell), so a large archive is read by many tasks.
Archives that no index row names, of attempts that failed, are deleted by `vacuum`.

Defined results: null html is an empty payload; null urls have no target URI; a null id is
written as none, and its row is always a response; rows that repeat the id and payload of a
response are responses too; digests are those of the full payload for either kind. A record whose
payload doesn't have its digest raises an error. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.shared import bitmap, dropped, lean, passes, thinned, written
from netloom.llm.wordcache import slices

#: Smaller payloads are always stored.
LEAST_BYTES = 1000
#: An archive is closed beyond so many bytes.
ARCHIVE = 64 << 20
#: Bytes between two records that are read rather than skipped; bytes of one read.
GAP, SPAN = 64 << 10, 8 << 20
#: Reads of a task.
TASK_SPANS = 4
DATE = "2000-01-01T00:00:00Z"

INDEX = "file string, offset long, length long, id long, url string, digest string, payload_bytes long, record_type string, refers_to long"


def _member(head: list[tuple[str, str]], block: bytes, level: int) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n") + z.flush()


def _record_id(row_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{row_id} {digest}')}>"


def _uri(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(row_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One gzip member."""
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _record_id(row_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _uri(url)))
    if row_id is not None:
        head.append(("X-Row-Id", str(row_id)))
    head.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    if refers_to is not None:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _record_id(refers_to, digest)), ("X-Refers-To-Row-Id", str(refers_to))]
    head.append(("Content-Type", "application/http; msgtype=response"))
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _member(head, block if refers_to is not None else block + payload, level)


def parse(member: bytes) -> dict:
    """The figures of one record; checks the payload of a response against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = fields["WARC-Type"]
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't have its digest")
    size = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"]
    whole = lambda k: int(fields[k]) if k in fields else None
    return {"id": whole("X-Row-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": int(size), "payload_digest": digest, "record_type": kind, "refers_to": whole("X-Refers-To-Row-Id"), "payload": payload if kind == "response" else None}


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = LEAST_BYTES, level: int = 6, archive: int = ARCHIVE) -> DataFrame:
    """Archives and index below folder; returns the index, read back."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    large = rows.filter(F.octet_length("payload") >= least_bytes).select("id", "digest")
    groups = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1").select("digest", "refers_to")
    revisits = written(large.join(groups, "digest").filter("id < refers_to").select("id", "digest", "refers_to").distinct(), "revisits", short=True)
    bits = bitmap(revisits, F.xxhash64("id", "digest"))
    may = (F.octet_length("payload") >= least_bytes) & passes(F.xxhash64("id", "digest"), bits.scalar())
    clear = rows.filter(~may).withColumn("refers_to", F.lit(None).cast("long"))
    known = revisits.select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "refers_to").hint("merge")  # never broadcast: it grows with the pages
    rest = rows.filter(may).join(known, (F.col("id") == F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    columns = ["id", "url", "payload", "digest", "refers_to"]
    typed = clear.select(columns).unionAll(thinned(rest.select(columns), 8))
    target = f"{folder}/archives"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        lean()
        store, base = fs.FileSystem.from_uri(target)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for b in (part for whole in batches for part in slices(whole, 2)):
                found = []
                for row_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at > archive:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, at = store.open_output_stream(f"{base}/{name}", compression=None), 0
                        info = _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"software: netloom\r\nformat: WARC File Format 1.1\r\n", level)
                        out.write(info)
                        at += len(info)
                    member = record(row_id, url, payload, digest, refers_to, level)
                    out.write(member)
                    found.append((f"{target}/{name}", at, len(member), row_id, url, digest, len(payload), "response" if refers_to is None else "revisit", refers_to))
                    at += len(member)
                columns = list(zip(*found, strict=True)) or [[]] * 9
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["file", "offset", "length", "id", "url", "digest", "payload_bytes", "record_type", "refers_to"])
        finally:
            if out is not None:
                out.close()

    # Index rows are committed only after their task, and so its archives, ended well.
    typed.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(f"{folder}/index")
    dropped(revisits)
    dropped(bits)
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete archives that no index row names, once no writer is at work; returns how many."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/archives")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not store.exists(path):
        return 0
    there = spark.createDataFrame([(f.getPath().getName(),) for f in store.listStatus(path)], "name string")
    known = index(spark, folder).select(F.element_at(F.split("file", "/"), -1).alias("name")).distinct()
    gone = [r["name"] for r in there.join(known, "name", "left_anti").collect()]
    for name in gone:
        store.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/archives/{name}"), False)
    return len(gone)


def coalesced(ranges: list[tuple[str, int, int]], gap: int, span: int) -> list[tuple[str, int, int, int]]:
    """Of ranges (file, offset, length) sorted so: reads (file, offset, length, number of ranges)."""
    out: list[tuple[str, int, int, int]] = []
    for file, offset, length in ranges:
        if out:
            f, o, n, k = out[-1]
            if f == file and offset - (o + n) <= gap and offset + length - o <= span:
                out[-1] = (f, o, max(n, offset + length - o), k + 1)
                continue
        out.append((file, offset, length, 1))
    return out


def read(chosen: DataFrame, payloads: bool = True, gap: int = GAP, span: int = SPAN) -> DataFrame:
    """Records of the chosen rows of an index: id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits, or if not wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        lean()
        open_name, source = None, None
        for b in batches:
            ranges = list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            i = 0
            for file, offset, length, k in coalesced(ranges, gap, span):
                if file != open_name:
                    store, path = fs.FileSystem.from_uri(file)
                    open_name, source = file, store.open_input_file(path)
                raw = source.read_at(length, offset)
                found = [parse(raw[o - offset : o - offset + n]) for _, o, n in ranges[i : i + k]]
                i += k
                if not payloads:
                    found = [x | {"payload": None} for x in found]
                yield pa.RecordBatch.from_pylist(found, schema=pa.schema([("id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]))

    rows = chosen.select("file", "offset", "length")
    total = rows.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(chosen.sparkSession.sparkContext.defaultParallelism, -(-total // (TASK_SPANS * span)))
    dealt = rows.repartition(tasks, "file", F.floor(F.col("offset") / span)).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(run, "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
