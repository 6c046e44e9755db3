"""Exact encoding and decoding with merge-type SentencePiece models, by backtracking.

The ids of a text are the only sequence of pieces in which each piece is what merging
its own characters gives, and each two neighbours stay apart when their joint characters
are merged anew. The encoder looks for that sequence directly: an Aho-Corasick automaton
gives the pieces that match at each position, the longest is tried first, a memo of
re-merged pairs tells whether it may follow its neighbour, and a bitfield marks positions
from which no way leads on, so that none is tried twice.

Why neighbours suffice: greedy merging takes the best pair of the whole text each time.
Seen from two neighbours alone, the merges within them come in the same order as if there
were nothing else. The first merge across a border would therefore also happen if the two
stood alone, which the re-merging check excludes.

Defined results: null and empty texts have no ids and decode to the empty text; characters
outside the vocabulary become their UTF-8 bytes' pieces; U+2581 in a text counts as a space
(so does the library). Equal rows give equal rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from netloom.llm.shared import lean
from netloom.llm.token_files import ENDINGS, LETTERS
from netloom.llm.wordcache import Memo, cut, encoded, gathered, slices, taken

SPACE = "▁"
#: Texts whose spaces stand otherwise than single between words.
ODD = "  | \n|^[ \n]| $"
#: Pairs in the memo of re-merged neighbours; beyond it the memo starts anew.
PAIRS = 200_000


class SentencePieceCodec:
    """Ids as the sentencepiece library gives them for a BPE model without text normalisation."""

    def __init__(self, model_path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(model_path, "rb") as f:
            spec = pb.ModelProto.FromString(f.read())
        norm, kind = spec.normalizer_spec, spec.trainer_spec
        if kind.model_type != 2 or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or kind.treat_whitespace_as_suffix or not kind.byte_fallback:
            raise ValueError(f"{model_path}: only merge-type models with byte pieces, a dummy prefix and no normalisation")
        lib = SentencePieceProcessor(model_file=model_path)
        n = lib.get_piece_size()
        names = [lib.id_to_piece(i) for i in range(n)]
        self.byte_id = {int(names[i][3:5], 16): i for i in range(n) if lib.is_byte(i)}
        if any(p.type == 4 for p in spec.pieces):
            raise ValueError(f"{model_path}: user-defined pieces are not supported")
        plain = [i for i in range(n) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i))]
        self.id = {names[i]: i for i in plain}
        self.score = {names[i]: lib.get_score(i) for i in plain}
        #: What each id adds to the decoded bytes.
        self.out = [b""] * n
        self.unknown = lib.unk_id()
        for i in plain:
            self.out[i] = names[i].replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.out[i] = bytes([b])
        self.out[self.unknown] = " ⁇ ".encode()
        self.decimal = [b"%d" % i for i in range(n)]
        self._bytes = frozenset(self.byte_id.values())
        self._pairs: dict[int, bool] = {}
        # By number of a piece, its id or, for characters that are none, a number beyond: text, length, ids as bytes, the longest proper prefix that is a piece too, down to one character.
        self._names, self._length = names, [len(p) for p in names]
        self._raw = [np.array([i], "<i4").tobytes() for i in range(n)]
        self._shorter: list[int] = [-1] * n
        self._char: dict[str, int] = {p: i for p, i in self.id.items() if len(p) == 1}
        self._trie = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(p) > 1 and self.merged(p) == [p]:
                self._trie.add_word(p, i)
        self._trie.make_automaton()
        for p, i in ((p, self.id[p]) for p in self._trie.keys()):
            for k in range(len(p) - 1, 0, -1):
                if k == 1 or p[:k] in self._trie:
                    self._shorter[i] = self._of_char(p[0]) if k == 1 else self.id[p[:k]]
                    break
        #: Neighbouring characters that stand side by side in some piece: merges cross no other border.
        self._joint = {a + b for p in self.id for a, b in zip(p, p[1:], strict=False)}
        self._parts = Memo(lambda parts: [b"".join(map(self._raw.__getitem__, self.split(p))) for p in parts])
        #: No piece goes on with a space sign after something else, or holds a newline: words begin there.
        by_word = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.id)
        self._odd = ODD if by_word else None
        self._newline = self._raw[self._of_char("\n")]
        self._runs = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if by_word else "(?s).+")
        self._cut = f"(?s)^(?P<stem>.*(?P<last>[{LETTERS}]))(?P<tail>(?P<next>[{re.escape(ENDINGS)}])[{re.escape(ENDINGS)}]*)$"

    def merged(self, text: str) -> list[str]:
        """Plain greedy merging: always the best-scored pair, of equals the leftmost."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _of_char(self, c: str) -> int:
        """The number of a character; one that is no piece gets a new one and becomes its bytes' pieces."""
        i = self._char.get(c)
        if i is None:
            i = self._char[c] = len(self._names)
            self._names.append(c)
            self._length.append(1)
            self._shorter.append(-1)
            self._raw.append(b"".join([self._raw[self.byte_id[b]] for b in c.encode("utf-8", "replace")]))
        return i

    def _apart(self, key: int) -> bool:
        """Whether two pieces stay what they are when their characters are merged anew."""
        if len(self._pairs) > PAIRS:
            self._pairs.clear()
        a, b = self._names[key >> 32], self._names[key & 0xFFFFFFFF]
        out = self._pairs[key] = self.merged(a + b) == [a, b]
        return out

    def split(self, chunk: str) -> list[int]:
        """The numbers of a chunk's pieces, by backtracking."""
        length, pairs, apart, shorter = self._length, self._pairs, self._apart, self._shorter
        try:
            longest = [self._char[c] for c in chunk]
        except KeyError:
            longest = [self._of_char(c) for c in chunk]
        for end, i in self._trie.iter(chunk):  # of equal starts the longest comes last
            longest[end - length[i] + 1] = i
        n = len(chunk)
        failed = 0  # bit i: no way leads on from position i
        out: list[int] = []
        pos, last = 0, -1
        piece = longest[0] if n else -1
        while pos < n:
            while piece >= 0:
                end = pos + length[piece]
                if not failed or not failed >> end & 1:
                    if last < 0:
                        break
                    key = last << 32 | piece
                    ok = pairs.get(key)
                    if ok is None:
                        ok = apart(key)
                    if ok:
                        break
                piece = shorter[piece]
            if piece >= 0:
                out.append(piece)
                last, pos = piece, end
                if pos < n:
                    piece = longest[pos]
            else:
                failed |= 1 << pos
                piece = out.pop()
                pos -= length[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]
        return out

    def _plain(self, texts: pa.StringArray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts (or parts of one) whose words are between single spaces: ids, how many each has."""
        words, at, first = cut(texts)
        line = pc.starts_with(words, "\n")
        body = pc.utf8_replace_slice(words, 0, 1, "")
        body = pc.if_else(line, body, words)
        ends = pc.extract_regex(body, self._cut)  # a word's closing punctuation, if no piece holds it side by side with the letter before
        border = pc.binary_join_element_wise(pc.struct_field(ends, "last"), pc.struct_field(ends, "next"), "").dictionary_encode()
        apart = np.array([b not in self._joint for b in border.dictionary.to_pylist()] + [False])[pc.fill_null(border.indices, len(border.dictionary)).to_numpy()]
        apart = pa.array(apart)
        whole = pc.if_else(apart, pc.struct_field(ends, "stem"), body)
        stem = pc.binary_join_element_wise(pc.if_else(line, "", SPACE), whole, "").dictionary_encode()
        tail = pc.fill_null(pc.if_else(apart, pc.struct_field(ends, "tail"), ""), "").dictionary_encode()
        stems, tails = self._parts.of(stem.dictionary.to_pylist()), self._parts.of(tail.dictionary.to_pylist())
        part = np.stack([line.to_numpy(zero_copy_only=False).astype("i4"), stem.indices.to_numpy() + 2, tail.indices.to_numpy() + 2 + len(stems)], 1)
        flat, size = gathered([b"", self._newline, *stems, *tails], part.ravel())
        ids, n = taken(flat, size.reshape(-1, 3).sum(1), at)
        return ids, np.add.reduceat(n, first)

    def _whole(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(self._parts.of(self._runs.findall(SPACE + text.replace(" ", SPACE)))), "<i4")

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; null is empty."""
        return encoded(pc.replace_substring(texts.cast(pa.string()), SPACE, " "), self._odd, self._plain, self._whole)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text."""
        return self.encode_all(pa.array([text], pa.string()))[0]

    def decode(self, ids: list[int] | np.ndarray) -> str:
        """The text of ids, as the library's decode(ids) gives it."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        raw = b"".join(map(self.out.__getitem__, ids))
        if ids and ids[0] not in self._bytes and raw[:1] == b" " and ids[0] != self.unknown:
            raw = raw[1:]  # the dummy prefix
        try:
            return raw.decode()
        except UnicodeDecodeError:  # ids that no encoder gave: each wrong byte is replaced
            return re.sub("[\udc80-\udcff]", "�", raw.decode(errors="surrogateescape"))

    def joined_decimals(self, ids: np.ndarray) -> bytes:
        return b",".join(map(self.decimal.__getitem__, ids.tolist()))


@functools.lru_cache(2)
def codec(model_path: str) -> SentencePieceCodec:
    """One for each Python worker."""
    lean()
    return SentencePieceCodec(model_path)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ids (array<int>) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in (part for whole in batches for part in slices(whole, 1)):
            flat, n = c.encode_all(b.column(1))
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype("i4")), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=[id_col, "ids"])

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col and text (decoded) of each row's ids; null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[id_col, "text"])

    src = encoded.select(id_col, ids_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_tokens, ids_sha256 and decoded_sha256: encode and decode in one pass, so that ids needn't leave the worker."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model_path)
        for b in (part for whole in batches for part in slices(whole, 1)):
            flat, n = c.encode_all(b.column(1))
            a, d = [], []
            for ids in np.split(flat, np.cumsum(n)[:-1]):
                a.append(hashlib.sha256(c.joined_decimals(ids)).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(d)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    src = docs.select(id_col, text_col)
    return src.mapInArrow(run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
