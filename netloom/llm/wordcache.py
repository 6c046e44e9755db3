"""Encoding whole texts by their distinct words.

A tokenizer's merges never cross certain places of a text. What lies between two such places
has ids that don't depend on what surrounds it. A block of texts is therefore cut into words at
once (at single spaces, and before newlines), equal words are told apart once, and ids are gathered
by word; ids of frequent parts of words are remembered.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of either generation of a memo, if not said otherwise (only speed and memory depend on it).
MEMO = 100_000
#: Longer parts are encoded each time.
MEMO_CHARS = 64
#: Bytes of texts that are looked at together.
BLOCK = 4 << 20


class Memo:
    """Ids (bytes of little-endian int32) of parts. Two generations: when the young one is full it becomes the old one; what is asked for there comes back."""

    def __init__(self, fill: Callable[[list[str]], list[bytes]], size: int = MEMO):
        self._size = size
        self._young: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._fill = fill

    def of(self, parts: list[str]) -> list[bytes]:
        if len(self._young) >= self._size:
            self._old, self._young = self._young, {}
        young, old = self._young, self._old
        got = list(map(young.get, parts))
        new = []
        for i in [i for i, x in enumerate(got) if x is None]:
            ids = old.get(parts[i])
            if ids is None:
                new.append(i)
            else:
                got[i] = young[parts[i]] = ids
        for i, ids in zip(new, self._fill([parts[i] for i in new]), strict=True):
            got[i] = ids
            if len(parts[i]) <= MEMO_CHARS:
                young[parts[i]] = ids
        return got


def slices(batch: pa.RecordBatch, text: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of the given column, so that what is made of them stays small."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(np.diff(np.cumsum(size, dtype="i8") // most)) + 1
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        if j > i:
            yield batch.slice(i, j - i)


def taken(flat: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that lie one after another in flat: those numbered at, likewise, and their sizes."""
    n = size[at]
    upto = np.cumsum(n, dtype="i8")
    total = int(upto[-1]) if len(upto) else 0
    kind = "i4" if max(total, len(flat)) < 1 << 31 else "i8"
    start = np.cumsum(size, dtype="i8") - size
    where = np.repeat((start[at] - upto + n).astype(kind), n)
    where += np.arange(total, dtype=kind)
    return flat[where], n


def gathered(lists: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return taken(np.frombuffer(b"".join(lists), "<i4"), np.fromiter(map(len, lists), "i4", len(lists)) >> 2, at)


def cut(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
    """Distinct words of texts (a newline begins a word); the words' numbers in order; where each text's words begin."""
    lists = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
    words = lists.flatten().dictionary_encode()
    first = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()
    return words.dictionary, words.indices.to_numpy().copy(), first


def encoded(texts: pa.Array, odd: str | None, plain_ids: Callable, whole_ids: Callable, most: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, one after another, and how many each has; null is empty. Blocks have about `most` bytes.

    plain_ids(texts, begins) encodes texts, or parts of one (those that don't begin it); whole_ids(text) the texts that match odd.
    """
    texts = pc.fill_null(texts.cast(pa.string()), "")
    size = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype("i8")
    plain = (size > 0) & (odd is not None)
    if plain.any():
        plain &= ~pc.match_substring_regex(texts, odd).to_numpy(zero_copy_only=False)
    counts = np.zeros(len(texts), "i8")
    out: list[np.ndarray] = []
    block = np.cumsum(size) // most
    i = 0
    while i < len(size):
        j = i + 1
        if plain[i] and size[i] <= most:  # a run of plain texts of one block
            while j < len(size) and plain[j] and block[j] == block[i]:
                j += 1
            ids, counts[i:j] = plain_ids(texts.slice(i, j - i), np.ones(j - i, bool))
            out.append(ids)
        elif plain[i]:  # a long one, in parts that end before a space
            text, at = texts[i].as_py(), 0
            while at < len(text):
                end = text.find(" ", at + most)
                end = len(text) if end < 0 else end
                ids, n = plain_ids(pa.array([text[at:end]]), np.array([at == 0]))
                out.append(ids)
                counts[i] += n[0]
                at = end + 1
        elif size[i]:
            out.append(whole_ids(texts[i].as_py()))
            counts[i] = len(out[-1])
        i = j
    return np.concatenate(out) if out else np.empty(0, "<i4"), counts
