"""Token counts by source, language and tokenizer version, kept up by signed deltas.

A batch of changes is reduced to signed sums by key: an insert adds a document and its
tokens, a delete takes them away, a revised count takes the old away and adds the new (the
keys of the two may differ). Totals are sums over all committed batches; sums add up in any order.

A commit writes its sums to a folder of its own, then a marker that names folder and batch: to a
temporary file first, which is renamed when it is whole. An attempt that dies before that leaves nothing that is ever read, so
the batch can be tried again. If several attempts at a batch end well, the marker whose name comes first counts and the others
don't, for every reader alike; so each batch counts once, however often and by however many drivers it is tried.

`compact` writes a marker that stands for the batches so far. Readers take those markers that stand for most batches, as
long as they have none in common, and single batches for what is left: two compactions of one state, or
one within another, change no total. `vacuum` deletes what a compaction has replaced, once nobody reads it any more.

Defined results: null source, language or version is a key like any other; null texts have no
tokens; rows that repeat an id are documents of their own; keys whose documents and tokens
both come to zero are left out; an empty batch can be committed; a column named counts is replaced; other extra columns are
not read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.wordcache import slices

KEYS = ["source", "lang", "tokenizer_version"]
SUMS = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


@functools.lru_cache(4)
def counter(path: str) -> Callable[[pa.Array], np.ndarray]:
    """Counts the tokens of each text: path is a byte-level BPE file, a SentencePiece model, or "words" (runs of what isn't white space)."""
    if path == "words":
        return lambda texts: np.array([len((t or "").split()) for t in texts.to_pylist()], "i8")
    if path.endswith(".model"):
        from netloom.llm.sentencepiece_codec import codec

        return lambda texts: codec(path).encode_all(texts)[1]
    from netloom.llm.token_files import byte_bpe

    return lambda texts: byte_bpe(path).encode_all(texts)[1]


def counted(docs: DataFrame, tokenizers: dict[str, str], text_col: str = "text") -> DataFrame:
    """docs without its text, plus counts: map of tokenizer version to tokens. tokenizers: version to path."""
    rest = [c for c in docs.columns if c not in (text_col, "counts")]
    src = docs.select(*[F.col(c) for c in rest], F.col(text_col))
    versions = sorted(tokenizers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = [counter(tokenizers[v]) for v in versions]
        for b in (part for whole in batches for part in slices(whole, len(rest))):
            made = np.stack([c(b.column(len(rest))) for c in count], 1)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype="i4") * len(versions))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.MapArray.from_arrays(offsets, pa.array(versions * b.num_rows, pa.string()), pa.array(made.ravel(), pa.int64()))], names=[*rest, "counts"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{fields}{', ' if fields else ''}counts map<string,bigint>")


def _signed(rows: DataFrame, sign: int, times: str | None = None) -> DataFrame:
    n = F.col(times).cast("long") * sign if times else F.lit(sign).cast("long")
    return rows.select("source", "lang", n.alias("n_docs"), F.explode("counts").alias("tokenizer_version", "n")).select(*KEYS, "n_docs", (F.col("n") * F.col("n_docs")).alias("n_tokens"))


def inserts(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Deltas of counted rows that are new; times: a column that says how many documents a row stands for, where not one."""
    return _signed(rows, 1, times)


def deletes(rows: DataFrame, times: str | None = None) -> DataFrame:
    """Deltas of counted rows that go."""
    return _signed(rows, -1, times)


def revisions(before: DataFrame, after: DataFrame, times: str | None = None) -> DataFrame:
    """Deltas of counted rows that have been replaced, row by row; source and language may have changed too."""
    return _signed(before, -1, times).unionAll(_signed(after, 1, times))


class Rollup:
    """Totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _markers(self) -> list[dict]:
        """One short row for each batch and compaction since the last vacuum: batch, data, stands_for, name. Of several of one batch, the first by name."""
        p, fs = self._path("commits")
        if not fs.exists(p):
            return []
        rows = self.spark.read.schema("batch string, data string, stands_for array<string>, name string").json(f"{self.folder}/commits").collect()
        first: dict[str, dict] = {}
        for r in sorted((r.asDict() for r in rows), key=lambda r: r["name"], reverse=True):
            first[r["batch"]] = r
        return list(first.values())

    def committed(self, batch: str) -> bool:
        return any(batch == r["batch"] or batch in r["stands_for"] for r in self._markers())

    def commit(self, batch: str, deltas: DataFrame) -> bool:
        """False, and nothing changes, if the batch has been committed before."""
        return not self.committed(batch) and self._write(batch, deltas, [])

    def _write(self, batch: str, deltas: DataFrame, stands_for: list[str]) -> bool:
        data = f"data/{uuid.uuid4().hex}"
        sums = deltas.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        sums.write.option("compression", "zstd").parquet(f"{self.folder}/{data}")
        name = f"{hashlib.sha256(batch.encode()).hexdigest()}-{uuid.uuid4().hex}.json"
        self._mark(name, {"batch": batch, "data": data, "stands_for": stands_for, "name": name})
        if next(r["name"] for r in self._markers() if r["batch"] == batch) == name:
            return True
        for mine in (f"commits/{name}", data):  # another attempt came first
            p, fs = self._path(mine)
            fs.delete(p, True)
        return False

    def _mark(self, name: str, marker: dict) -> None:
        p, fs = self._path(f"commits/_{name}")  # not read until it has its name
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(marker).encode()))
        out.close()
        if not fs.rename(p, self._path(f"commits/{name}")[0]):
            raise OSError(f"{name} can't be renamed")

    def _live(self) -> tuple[list[dict], list[dict]]:
        """Markers that count, each batch in one of them, and those that don't."""
        rows = self._markers()
        taken: list[dict] = []
        done: set[str] = set()
        for r in sorted(rows, key=lambda r: (-len(r["stands_for"]), r["name"])):
            mine = set(r["stands_for"]) or {r["batch"]}
            if not mine & done:
                taken.append(r)
                done |= mine
        return taken, [r for r in rows if r not in taken]

    def totals(self) -> DataFrame:
        """KEYS, n_docs, n_tokens."""
        return self._sums(self._live()[0])

    def _sums(self, live: list[dict]) -> DataFrame:
        parts = [self.spark.read.schema(SUMS).parquet(f"{self.folder}/{r['data']}") for r in live]
        if not parts:
            return self.spark.createDataFrame([], SUMS)
        return reduce(DataFrame.unionAll, parts).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter("n_docs <> 0 or n_tokens <> 0")

    def compact(self) -> bool:
        """One marker of sums in place of all so far."""
        live = self._live()[0]
        batches = sorted({b for r in live for b in r["stands_for"] or [r["batch"]]})
        return len(live) > 1 and self._write(f"sum of {uuid.uuid4().hex}", self._sums(live), batches)

    def vacuum(self) -> int:
        """Delete markers and sums that no longer count, and return how many; only while nobody else reads or compacts."""
        gone = self._live()[1]
        for r in gone:
            for name in (f"commits/{r['name']}", r["data"]):
                p, fs = self._path(name)
                fs.delete(p, True)
        return len(gone)
