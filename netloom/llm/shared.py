"""What the operators here have in common: the shared folder, written tables, texts in Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from functools import cache, reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a bitmap of hashes.
BITMAP = 1 << 21


@cache
def lean() -> None:
    """Has a Python worker give memory back as soon as it is free, once for each process: Arrow's own pool and the C library keep it otherwise."""
    pa.set_memory_pool(pa.system_memory_pool())
    with contextlib.suppress(OSError, AttributeError):  # other C libraries
        c = ctypes.CDLL("libc.so.6")
        c.mallopt(-3, 1 << 18)  # larger pieces are mapped, and unmapped when they are free
        c.mallopt(-1, 1 << 20)  # free memory at the top beyond this goes back


def shared_dir(spark: SparkSession) -> str:
    """A folder that the driver and all executors see.

    It is the session's spark.checkpoint.dir; where that is unset (tests on one
    machine), a temporary folder is made and set.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not root:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        root = sc._jsc.sc().getCheckpointDir().get()
    root = root.rstrip("/")
    return f"{root}/{sc.applicationId}" if "://" in root or root.startswith("file:") else f"file://{root}/{sc.applicationId}"


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


#: Shuffle partitions whose rows go to one file of a table of short rows.
THIN = 32


def thinned(df: DataFrame, by: int = THIN) -> DataFrame:
    """In so many times fewer partitions than a shuffle makes."""
    return df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // by))


def written(df: DataFrame, label: str, compression: str = "zstd", short: bool = False, **options: str) -> DataFrame:
    """The same rows, from a Parquet table in the shared folder: lineage ends there and lost executors cost no rerun.

    short: rows are a few numbers each, so that several shuffle partitions go to one file.
    """
    spark, path = df.sparkSession, fresh_path(df.sparkSession, label)
    made = thinned(df) if short else df
    made.write.options(compression=compression, **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete a table made by written() that no plan needs any more."""
    path = getattr(df, "_shared_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """A hash that stands for a text; null is empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _places(h: Column) -> list[Column]:
    """The two bits of a bitmap that stand for a hash."""
    return [h.bitwiseAND(F.lit(BITMAP - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(BITMAP - 1))]


def passes(h: Column, bitmap: Column) -> Column:
    """True for every hash in the bitmap, and for some others."""
    return reduce(Column.__and__, [F.getbit(F.get(bitmap, F.shiftrightunsigned(p, 6).cast("int")), p.bitwiseAND(F.lit(63)).cast("int")) == 1 for p in _places(h)])


def bitmap(rows: DataFrame, h: Column) -> DataFrame:
    """One row with one array of a fixed size (256 KB): the bits of all hashes. As a scalar it lets scans leave out rows that no join will find; the join decides."""
    place = rows.select(F.explode(F.array(*_places(h))).alias("p")).distinct()
    set_ = place.groupBy(F.shiftrightunsigned("p", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits"))
    every = rows.sparkSession.range(BITMAP >> 6).join(set_, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    return written(every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "bits"))), lambda x: x["bits"]).alias("bitmap")), "bitmap", short=True)


def split_off(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column, DataFrame, Column]:
    """docs without the rows that may be among keys (id, key: text_key of the text); those rows, as `doc`; keys as `one`, and what joins them."""
    bits = bitmap(keys, F.xxhash64("id", "key"))
    may = passes(F.xxhash64(id_col, text_key(F.col(text_col))), bits.scalar())
    same = F.col(f"doc.{id_col}").eqNullSafe(F.col("one.id")) & (text_key(F.col(f"doc.{text_col}")) == F.col("one.key"))
    return docs.filter(~may), docs.filter(may).alias("doc"), keys.alias("one").hint("merge"), same  # never broadcast: keys grow with the documents


def without(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text aren't among keys. Only rows that may be are dealt out anew."""
    clear, rest, one, same = split_off(docs, keys, id_col, text_col)
    return clear.unionAll(thinned(rest.join(one, same, "left_anti"), 8))  # few rows: their files shouldn't be as many as all others
