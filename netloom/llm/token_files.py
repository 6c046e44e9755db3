"""Token ids of whole texts in Parquet files made for selective reads.

One row a text, in ascending id order: id, part (number of the range), start (ids of the
part before this text), n_tokens, ids (list of int32). The list column is dictionary
encoded (a vocabulary of 50,000 takes 16 bits an id before compression) or, where a page's
dictionary would grow too large or when asked for, written with version 2 pages, whose
integers are delta encoded. Row groups are small and pages hold a bounded number of rows;
the writer adds column and offset indexes, so that a read of some ids touches few pages and
a read of the metadata columns touches no ids at all.

Defined results: null texts count as empty and hold only the end id; rows with equal ids
all stay, in the order in which they were read; null ids come first; special strings in texts become
their ids, as in the library; extra columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netloom.llm.shared import dropped, lean, written
from netloom.llm.wordcache import Memo, cut, encoded, gathered, slices, taken

#: Bytes of a row group, bytes and rows of a page at most.
ROW_GROUP, PAGE, PAGE_ROWS = 16 << 20, 256 << 10, 500
#: Bytes of texts that are looked at together: the more, the fewer distinct words are told apart and looked up again.
TOGETHER = 16 << 20


#: Punctuation that may end a word (not the apostrophe, which may begin an ending of its own).
ENDINGS = ".,;:!?*#&%$)]}>\"-_=+/|"
#: Letters (of blocks that every version of Unicode agrees on), as a regular expression's class.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: White space other than space and newline, likewise.
SPACES = "\t\r\v\f\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts in which white space stands otherwise than single between words, or at an end.
ODD = f"  | \n|\n |\n\n|^[ \n]|[ \n]$|[{SPACES}]"


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next from U+0100 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    unseen = [b for b in range(256) if b not in seen]
    return [chr(b if b in seen else 256 + unseen.index(b)) for b in range(256)]


class ByteBpe:
    """Ids as the tokenizers library gives them for a byte-level BPE file with add_special_tokens=False.

    The library's split of a text never joins a word with the space or newline before the next one. Where all white
    space is single spaces and newlines between words, a block of texts is therefore cut into words at once, equal
    words are told apart once, and ids are gathered by word. What is asked of the library are stems and endings of
    words that aren't remembered. Texts with other white space or with special strings go to the library whole.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, [t["content"] for t in spec.get("added_tokens") or []]
        #: With this split, a single space between two words always opens a new chunk, and so does a newline.
        by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer") and not any(len(t.split()) != 1 for t in added)
        self._tok = Tokenizer.from_file(path)
        self._model, self._letters = self._tok.model, dict(enumerate(_byte_letters()))
        self._whole = re.compile(f" ?[{LETTERS}]+").fullmatch  # such a part is a chunk of its own in the library's split
        self._cut = f"(?s)^(?P<stem>.*[{LETTERS}])(?P<tail>[{re.escape(ENDINGS)}]+)$"
        self._parts = Memo(self._asked, 250_000)
        newline = self._tok.encode("\n", add_special_tokens=False).ids
        by_word = by_word and len(newline) == 1
        self._newline_id, self._newline = newline[0] if newline else -1, np.array(newline, "<i4").tobytes()
        self._odd = "|".join([ODD, *(re.escape(t) for t in added)]) if by_word else None
        #: Bytes of an unsigned number that holds every id.
        self.width = 2 if self._tok.get_vocab_size() <= 1 << 16 else 4

    def _asked(self, parts: list[str]) -> list[bytes]:
        """Ids of parts without white space but at their start, from the library."""
        own, mixed = [], []
        for i, x in enumerate(parts):
            (own if self._whole(x) else mixed).append(i)
        out: list[bytes] = [b""] * len(parts)
        if own:
            tokenize, ids, begin = self._model.tokenize, [], [0]
            for x in "\n".join([parts[i] for i in own]).encode().decode("latin-1").translate(self._letters).split(self._letters[10]):
                ids += [t.id for t in tokenize(x)]
                begin.append(len(ids))
            raw = np.array(ids, "<i4").tobytes()
            for i, a, b in zip(own, begin, begin[1:], strict=False):
                out[i] = raw[4 * a : 4 * b]
        if mixed:  # in one call, as lines of a text, whose newlines have an id of their own
            ids = np.array(self._tok.encode_batch_fast(["\n".join([parts[i] for i in mixed])], add_special_tokens=False)[0].ids, "<i4")
            ends = np.flatnonzero(ids == self._newline_id)
            raw, begin = ids.tobytes(), 4 * np.concatenate([[0], ends + 1])
            for i, a, b in zip(mixed, begin.tolist(), [*(4 * ends).tolist(), len(raw)], strict=True):
                out[i] = raw[a:b]
        return out

    def _words(self, words: pa.StringArray, follow: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words: all their ids, how many each has. The first `follow` come after a space, or else begin with a newline, a chunk of its own; the rest begin a text."""
        line = pc.starts_with(words, "\n")
        body = pc.utf8_ltrim(words, characters="\n")
        ends = pc.extract_regex(body, self._cut)  # a word's closing punctuation, after a letter, is a chunk of its own too
        whole = pc.if_else(pc.is_valid(ends), pc.struct_field(ends, "stem"), body)
        lead = pc.if_else(pa.array(np.arange(len(words)) < follow), pc.if_else(line, "", " "), "")
        stem = pc.binary_join_element_wise(lead, whole, "").dictionary_encode()
        tail = pc.fill_null(pc.struct_field(ends, "tail"), "").dictionary_encode()
        stems, tails = self._parts.of(stem.dictionary.to_pylist()), self._parts.of(tail.dictionary.to_pylist())
        at = np.stack([line.to_numpy(zero_copy_only=False).astype("i4"), stem.indices.to_numpy() + 2, tail.indices.to_numpy() + 2 + len(stems)], 1)
        ids, size = gathered([b"", self._newline, *stems, *tails], at.ravel())
        return ids, size.reshape(-1, 3).sum(1)

    def _plain(self, texts: pa.StringArray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (or parts of one, those that don't begin it) whose words are between single spaces and newlines: ids, how many each has."""
        words, at, first = cut(texts)
        follow = len(words)
        heads, where = np.unique(at[first[begins]], return_inverse=True)
        at[first[begins]] = follow + where
        flat, size = self._words(pa.concat_arrays([words, words.take(pa.array(heads))]), follow)
        ids, n = taken(flat, size, at)
        return ids, np.add.reduceat(n, first)

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; null is empty."""
        whole = lambda text: np.array(self._tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<i4")
        return encoded(texts, self._odd, self._plain, whole, TOGETHER)

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all(pa.array([text], pa.string()))[0]


@functools.lru_cache(2)
def byte_bpe(path: str) -> ByteBpe:
    """One for each Python worker."""
    lean()
    return ByteBpe(path)


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", delta: bool = False) -> None:
    """Encode each row's whole text, add end_id, and write the files.

    Texts never move: ids do, as numbers of two bytes where the vocabulary allows, from a table in the shared folder,
    so that neither the ranges' sampling nor a lost executor encodes anything twice.
    """

    def packed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = byte_bpe(tokenizer_path)
        for b in (part for whole in batches for part in slices(whole, 2, TOGETHER)):
            ids, n = tok.encode_all(b.column(2))
            upto = tok.width * np.concatenate([[0], np.cumsum(n)])
            raw = ids.astype(f"<u{tok.width}").tobytes()
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(upto.astype("<i8").tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.full(len(n), tok.width), pa.int32()), packed.cast(pa.binary())], names=["id", "row", "width", "packed"])

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, part = 0, TaskContext.get().partitionId()
        end = np.array([end_id], "<i4")
        for b in batches:
            flat = []
            for w, x in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                flat += (np.frombuffer(x.as_buffer(), f"<u{w}").astype("<i4"), end)
            n = np.array([len(x) + 1 for x in flat[::2]], "i8")
            upto = np.cumsum(n)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], upto]).astype("i4")), pa.array(np.concatenate(flat) if flat else np.empty(0, "i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part), pa.int32()), pa.array(start + upto - n, pa.int64()), pa.array(n, pa.int64()), ids], names=["id", "part", "start", "n_tokens", "ids"])
            start += int(upto[-1]) if len(n) else 0

    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))
    packed = written(src.mapInArrow(packed_ids, f"id {kind}, row long, width int, packed binary"), "packed", **{"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"})  # read once
    # By id and row, so that many rows of one id make several ranges.
    dealt = packed.repartitionByRange("id", "row").sortWithinPartitions("id", "row").select("id", "width", "packed")
    (
        dealt.mapInArrow(filed, f"id {kind}, part int, start long, n_tokens long, ids array<int>")
        .write.option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP)
        .option("parquet.page.size", PAGE)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .option("parquet.enable.dictionary", str(not delta).lower())
        .option("parquet.writer.version", "PARQUET_2_0")
        .parquet(path)
    )
    dropped(packed)


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """id, start (ids of all texts before it), n_tokens, part: no ids are read."""
    return _global(spark, path, spark.read.parquet(path).select("id", "part", "start", "n_tokens"))


def _global(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """rows with start counted from the first part on. A part's offset is the sum of the parts before it; those sums, one number for each written partition, are gathered in the driver."""
    sums = {r["part"]: r["n"] for r in spark.read.parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()}
    before, at = [], 0
    for part in sorted(sums):
        before.append((part, at))
        at += sums[part]
    offsets = spark.createDataFrame(before, "part int, before_part long")
    return rows.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("before_part")).drop("before_part")


def read(spark: SparkSession, path: str, low=None, high=None) -> DataFrame:
    """id, start, n_tokens, part, ids; only of texts with low <= id <= high, where given (row groups and pages outside are skipped)."""
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.filter(F.col("id") >= low)
    if high is not None:
        rows = rows.filter(F.col("id") <= high)
    return _global(spark, path, rows)


def digests(tokens: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id_col, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of what read() gives."""
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at, raw = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crc = [zlib.crc32(raw[i:j]) for i, j in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=[id_col, "start", "n_tokens", "ids_crc32"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "start", "n_tokens", "ids").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")
