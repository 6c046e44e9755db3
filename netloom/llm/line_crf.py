"""Document quality from a linear-chain conditional random field over lines.

Each line gets a state, good or bad. Its score is linear in figures of the line itself and
of the lines before and after it (shares of kinds of characters, word lengths, how it
begins and ends, whether the document has the same line elsewhere), and two neighbours' states have
a score of their own. Forward-backward gives each line's probability of being good; a
document's score is their mean, weighted by the lines' lengths.

Labels are of documents, lines of a document may differ. In training, all lines of a good document are observed as good. Those of a bad
one are first observed as bad; then a first fit is asked, and lines that it holds for good become latent (up to half of
a document's characters): the likelihood sums over their states. Scores of steps are bounded by `STEP`, so that no chain is
forced to keep its state: `line_labels` gives mixed documents mixed lines. The log-likelihood is climbed in the driver, on a
bounded sample of labelled rows: `sample` documents at most (those with the smallest hash of their id), and of these, in that
order, as many as have `sample_lines` lines together (none of which has over a quarter of them alone). Only figures of those lines reach the driver, no texts.

Inputs of a score are the text's own bytes: no label, language, source or id. Defined
results: null and empty texts are one empty line and get a score like any other; texts of
any length are read whole, in blocks of bytes, so that a line or a text takes a few numbers a line beside its bytes; equal rows get equal rows; labels that
are null or belong to no document don't count; of an id's labels, the best counts; with no usable label of either kind every score is the share of good
labels (1 if there are none). Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.shared import lean, written

#: Kinds of bytes whose share of a line is a figure.
KINDS = ["ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", " ", ".", ",", "!", "?", "|", "*#&%$", "<>", "(){}[]", "\"'`", ":;", "/\\", "-_=+~^@", "\t\r\v\f"]
WORD = re.compile(rb"\S+")
#: Bytes of texts that are looked at together.
BLOCK = 1 << 20
#: Largest score of a step, either way.
STEP = 0.5
#: Lines of a document from which on its chain is followed line by line, not along with other documents'.
LONG = 256
#: Newlines inside documents' bytes end a line.
NEWLINE = 10
DOCS, LINES = 4000, 150_000


def _kind_table() -> np.ndarray:
    out = np.full(256, len(KINDS), "u1")  # the last kind: whatever else, such as control characters
    for k, chars in enumerate(KINDS):
        out[[ord(c) for c in chars]] = k
    out[128:] = len(KINDS) + 1  # bytes of characters outside ASCII
    return out


TABLE = _kind_table()
N_KINDS = len(KINDS) + 2
OWN = N_KINDS + 8
#: Own figures, those of both neighbours, first line, last line, constant.
WIDTH = 3 * OWN + 3


def _counts(joined: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bytes of each kind by line (newlines count nothing), and bytes that go on with a character; stop: where lines end."""
    out = np.zeros((len(stop), N_KINDS + 1), "i8")
    for a in range(0, len(joined), BLOCK):
        part = joined[a : a + BLOCK]
        lo, hi = np.searchsorted(stop, [a, a + len(part) - 1])
        line = np.cumsum(part == NEWLINE, dtype="i4")
        line -= part == NEWLINE
        n = hi - lo + 1
        out[lo : lo + n, :N_KINDS] += np.bincount(line * N_KINDS + TABLE[part], minlength=n * N_KINDS)[: n * N_KINDS].reshape(n, N_KINDS)
        out[lo : lo + n, N_KINDS] += np.bincount(line[(part & 0xC0) == 0x80], minlength=n)[:n]
    out[:, len(KINDS)] -= 1  # the newline itself
    return out


def own_figures(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents values[starts[i]:ends[i]] (bytes): figures by line, without neighbours; characters by line, at least 1; lines by document."""
    doc_bytes = ends - starts
    # All texts, each with a newline after it, so that each line ends with one.
    total = int(doc_bytes.sum() + len(starts))
    joined = np.full(total, NEWLINE, "u1")
    at = np.cumsum(doc_bytes + 1) - (doc_bytes + 1)
    for a, s, e in zip(at.tolist(), starts.tolist(), ends.tolist(), strict=True):
        joined[a : a + e - s] = values[s:e]
    stop = np.flatnonzero(joined == NEWLINE)
    first = np.concatenate([[0], stop[:-1] + 1])
    n = (stop - first).astype("f8")
    doc_of = np.searchsorted(at, first, "right") - 1
    counts = _counts(joined, stop)
    own = np.zeros((len(stop), OWN), "f4")
    own[:, :N_KINDS] = np.sqrt(counts[:, :N_KINDS] / np.maximum(n, 1)[:, None])
    begin, last = joined[first], joined[np.maximum(stop - 1, 0)]
    own[:, N_KINDS] = np.log1p(n) / 8
    own[:, N_KINDS + 1] = np.minimum(np.log1p(n / (counts[:, 3] + 1)) / 4, 2)
    own[:, N_KINDS + 2] = n == 0
    own[:, N_KINDS + 3] = (n > 0) & (TABLE[begin] == 0)
    own[:, N_KINDS + 4] = (n > 0) & np.isin(last, np.frombuffer(b".!?", "u1"))
    own[:, N_KINDS + 5] = (n > 0) & (n < 40)
    own[:, N_KINDS + 6], own[:, N_KINDS + 7] = _repeated(joined, first, stop, doc_of)
    return own, n - counts[:, N_KINDS] + 1, np.bincount(doc_of, minlength=len(starts))


def _ends(lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which lines are a document's first and last."""
    head, tail = np.zeros(int(lines.sum()), bool), np.zeros(int(lines.sum()), bool)
    upto = np.cumsum(lines)
    head[upto - lines], tail[upto - 1] = True, True
    return head, tail


def line_figures(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same with the figures of both neighbours, and of being first or last."""
    own, weight, lines = own_figures(values, starts, ends)
    head, tail = _ends(lines)
    figures = np.zeros((len(own), WIDTH), "f4")
    figures[:, :OWN] = own
    figures[1:, OWN : 2 * OWN] = np.where(head[1:, None], 0, own[:-1])
    figures[:-1, 2 * OWN : 3 * OWN] = np.where(tail[:-1, None], 0, own[1:])
    figures[:, 3 * OWN], figures[:, 3 * OWN + 1], figures[:, 3 * OWN + 2] = head, tail, 1
    return figures, weight, lines


def potentials(own: np.ndarray, lines: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What line_figures(...) @ weights gives, from own figures."""
    a, b, c = (own @ weights[i * OWN : (i + 1) * OWN].astype("f4") for i in range(3))
    head, tail = _ends(lines)
    u = a.astype("f8") + weights[3 * OWN] * head + weights[3 * OWN + 1] * tail + weights[3 * OWN + 2]
    u[1:] += np.where(head[1:], 0, b[:-1])
    u[:-1] += np.where(tail[:-1], 0, c[1:])
    return u


def _repeated(joined, first, stop, doc_of) -> tuple[np.ndarray, np.ndarray]:
    """Whether a line of some length occurs elsewhere in its document, and the share of its words that it holds before already."""
    raw = joined.tobytes()
    again, echo = np.zeros(len(first), "f4"), np.zeros(len(first), "f4")
    seen: dict[int, int] = {}
    doc = -1
    for i, (a, b, d) in enumerate(zip(first.tolist(), stop.tolist(), doc_of.tolist(), strict=True)):
        if d != doc:
            seen, doc = {}, d
        if b - a > 3:
            line = raw[a:b]
            j = seen.setdefault(hash(line), i)
            if j != i:
                again[i] = again[j] = 1
            if b - a <= BLOCK:
                words = line.split()
                echo[i] = 1 - len(set(words)) / len(words) if words else 0
            else:  # without a list of all words
                known, n = set(), 0
                for m in WORD.finditer(line):
                    known.add(hash(m[0]))
                    n += 1
                echo[i] = 1 - len(known) / n if n else 0
    return again, echo


@dataclass
class Model:
    """weights: of a good line's figures. steps: scores of (bad, bad), (bad, good), (good, bad), (good, good)."""

    weights: np.ndarray
    steps: np.ndarray
    prior: float = 1.0


def _chains(lines: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """By position: the chains (longest first) that are as long, as indices of their lines."""
    order = np.argsort(-lines, kind="stable")
    begin = (np.cumsum(lines) - lines)[order]
    left = lines[order]
    out = []
    for t in range(int(left[0]) if len(left) else 0):
        k = int(np.searchsorted(-left, -t, "left"))  # chains longer than t
        out.append(begin[:k] + t)
    return out


def marginals(u: np.ndarray, steps: np.ndarray, lines: np.ndarray):
    """p(good) by line; expected counts of the four steps; log of the sum over all sequences."""
    chains = _chains(lines)
    a = np.zeros((len(u), 2))
    b = np.zeros((len(u), 2))
    e = np.exp(steps.reshape(2, 2))
    scale = np.zeros(len(u))
    emit = np.stack([np.zeros_like(u), u], 1)
    top = emit.max(1)
    emit = np.exp(emit - top[:, None])
    for t, at in enumerate(chains):
        x = emit[at] if t == 0 else (a[chains[t - 1][: len(at)]] @ e) * emit[at]
        s = x.sum(1)
        a[at], scale[at] = x / s[:, None], s
    for t in range(len(chains) - 1, -1, -1):
        at = chains[t]
        b[at] = 1
        if t + 1 < len(chains):
            nxt = chains[t + 1]
            b[at[: len(nxt)]] = ((emit[nxt] * b[nxt]) @ e.T) / scale[nxt][:, None]
    p = a * b
    p /= p.sum(1, keepdims=True)
    count = np.zeros((2, 2))
    for t in range(1, len(chains)):
        at, was = chains[t], chains[t - 1][: len(chains[t])]
        x = a[was][:, :, None] * e[None] * (emit[at] * b[at] / scale[at][:, None])[:, None, :]
        count += x.sum(0)
    return p[:, 1], count.ravel(), float(np.log(scale).sum() + top.sum())


def _long_chain(u: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """p(good) by line of one document: the ratio of good to bad, forward and backward."""
    e00, e01, e10, e11 = np.exp(steps).tolist()
    odds = np.exp(np.clip(u, -300, 300)).tolist()
    ahead, r = [], None
    for x in odds:
        r = x if r is None else x * (e01 + e11 * r) / (e00 + e10 * r)
        ahead.append(r)
    p, s = np.empty(len(odds)), 1.0
    for t in range(len(odds) - 1, -1, -1):
        both = ahead[t] * s
        p[t] = both / (1 + both)
        w = odds[t] * s
        s = (e10 + e11 * w) / (e00 + e01 * w)
    return p


def probabilities(u: np.ndarray, steps: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """p(good) by line."""
    out, begin = np.empty(len(u)), np.cumsum(lines) - lines
    long = lines > LONG
    for a, n in zip(begin[long].tolist(), lines[long].tolist(), strict=True):
        out[a : a + n] = _long_chain(u[a : a + n], steps)
    if not long.all():
        rest = np.repeat(~long, lines)
        out[rest] = marginals(u[rest], steps, lines[~long])[0]
    return out


#: Added to a line's potential to say which state is observed.
SURE = 60.0


def _climb(x: np.ndarray, lines: np.ndarray, observed: np.ndarray, w: np.ndarray, penalty: float, rounds: int) -> np.ndarray:
    """Weights and steps (through tanh) of the largest penalised mean log-likelihood of the observed states (1 good, -1 bad, 0 latent), by limited-memory BFGS with halved steps."""
    docs = len(lines)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        u, t = x @ w[:WIDTH], np.tanh(w[WIDTH:])
        p, count, z = marginals(u, STEP * t, lines)
        q, seen, zo = marginals(u + SURE * observed, STEP * t, lines)
        value = (z - zo + SURE * (observed > 0).sum()) / docs + penalty / 2 * (w @ w)
        return value, np.concatenate([x.T @ (p - q), (count - seen) * STEP * (1 - t * t)]) / docs + penalty * w

    f, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = g.copy(), []
        for s, d in reversed(past):
            k = (s @ q) / (s @ d)
            alphas.append(k)
            q -= k * d
        if past:
            s, d = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d), k in zip(past, reversed(alphas), strict=True):
            q += s * (k - (d @ q) / (s @ d))
        step = 1.0 if past else min(1.0, 1 / max(np.abs(g).max(), 1e-9))
        for _ in range(30):
            nw = w - step * q
            nf, ng = loss(nw)
            if nf <= f - 1e-4 * step * (g @ q):
                break
            step /= 2
        else:
            break
        s, d = nw - w, ng - g
        if s @ d > 1e-10:
            past = [*past, (s, d)][-10:]
        done = f - nf < 1e-6 * max(1, abs(f))
        w, f, g = nw, nf, ng
        if done:
            break
    return w


def fit(figures: np.ndarray, lines: np.ndarray, good: np.ndarray, weight: np.ndarray | None = None, penalty: float = 1e-5, rounds: int = 100) -> Model:
    """weight: characters by line."""
    if len(good) == 0 or good.min() == good.max():
        return Model(np.zeros(WIDTH), np.zeros(4), float(good.mean()) if len(good) else 1.0)
    x, state = figures.astype("f8"), np.repeat(np.where(good, 1.0, -1.0), lines)
    weight = np.ones(len(x)) if weight is None else weight
    w = _climb(x, lines, state, np.zeros(WIDTH + 4), penalty, rounds)
    # Lines of bad documents that look good may be so: latent from now on, the likeliest first, up to half of the document.
    p = probabilities(x @ w[:WIDTH], STEP * np.tanh(w[WIDTH:]), lines)
    doc = np.repeat(np.arange(len(lines)), lines)
    order = np.lexsort((-p, doc))
    before = np.cumsum(weight[order]) - np.repeat((np.cumsum(np.bincount(doc, weight)) - np.bincount(doc, weight)), lines)
    latent = np.zeros(len(x), bool)
    latent[order] = before <= np.bincount(doc, weight)[doc[order]] / 2
    latent &= (p > 0.5) & (state < 0)
    if latent.any():
        w = _climb(x, lines, np.where(latent, 0.0, state), w, penalty, rounds)
    return Model(w[:WIDTH], STEP * np.tanh(w[WIDTH:]))


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 of a string column, null as empty: all bytes, starts, ends."""
    column = column.fill_null("") if column.null_count else column
    buffers = column.buffers()
    wide = "i8" if pa.types.is_large_string(column.type) else "i4"
    at = np.frombuffer(buffers[1], wide)[column.offset : column.offset + len(column) + 1].astype("i8")
    values = np.frombuffer(buffers[2], "u1") if buffers[2] is not None else np.empty(0, "u1")
    return values, at[:-1], at[1:]


def _blocks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i to j and their bytes, as many together as BLOCK allows, one at least."""
    lean()
    values, starts, ends = _bytes_of(column)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        yield i, j, values, starts[i:j], ends[i:j]
        i = j


def _by_line(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows i to j, p(good) and characters by line, lines by row."""
    for i, j, values, starts, ends in _blocks(column):
        own, weight, lines = own_figures(values, starts, ends)
        p = probabilities(potentials(own, lines, model.weights), model.steps, lines) if model.weights.any() else np.full(len(own), model.prior)
        yield i, j, p, weight, lines


def score_texts(column: pa.Array, model: Model) -> np.ndarray:
    out = np.empty(len(column))
    for i, j, p, weight, lines in _by_line(column, model):
        at = np.cumsum(lines) - lines
        out[i:j] = np.add.reduceat(p * weight, at) / np.add.reduceat(weight, at)
    return np.clip(out, 0, 1)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = DOCS, sample_lines: int = LINES) -> Model:
    """labels: id_col and label_col (1 is good), as far as they may be learnt from."""
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col)).alias("_good"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id").limit(sample)  # at most `sample` short rows: small enough to send to all

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, values, starts, ends in _blocks(b.column(1)):
                figures, weight, lines = line_figures(values, starts, ends)
                at = np.concatenate([[0], np.cumsum(lines)])
                raw = [figures[at[k] : at[k + 1]].tobytes() for k in range(j - i)]
                chars = [weight[at[k] : at[k + 1]].astype("f8").tobytes() for k in range(j - i)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(lines, pa.int64()), pa.array(raw, pa.binary()), pa.array(chars, pa.binary())], names=["good", "lines", "figures", "chars"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    seen = docs.select(F.col(id_col).alias("_id"), text.alias("text")).join(F.broadcast(chosen), "_id").select(F.xxhash64("_id").alias("at"), F.col("_good").cast("int").alias("good"), "text", F.size(F.split("text", "\n")).alias("lines"))
    seen = written(seen, "sample")  # the whole sample is looked at for its lines first, then as much of it as fits
    upto = F.sum("lines").over(Window.orderBy("at", "lines", F.xxhash64("text")).rowsBetween(Window.unboundedPreceding, 0))
    taken = seen.filter(F.col("lines") <= sample_lines // 4).select("at", "lines", "text").withColumn("upto", upto).filter(F.col("upto") <= sample_lines).select("at", F.xxhash64("text").alias("key")).distinct()
    figured = seen.join(F.broadcast(taken), (seen.at == taken.at) & (F.xxhash64("text") == F.col("key"))).select("good", "text").mapInArrow(run, "good int, lines long, figures binary, chars binary")
    rows = sorted(figured.collect(), key=lambda r: (r["lines"], bytes(r["figures"])[:512], r["good"]))
    figures = np.concatenate([np.empty((0, WIDTH), "f4"), *[np.frombuffer(r["figures"], "f4").reshape(-1, WIDTH) for r in rows]])
    chars = np.concatenate([np.empty(0), *[np.frombuffer(r["chars"], "f8") for r in rows]])
    return fit(figures, np.array([r["lines"] for r in rows], "i8"), np.array([min(max(r["good"], 0), 1) for r in rows], "i8"), chars)


def line_labels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, line (from 0), chars, good (its probability), label (1 from 0.5 on) of every line of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, p, weight, lines in _by_line(b.column(1), model):
                row = np.repeat(np.arange(len(lines)), lines)
                number = np.arange(len(row)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row + i)), pa.array(number, pa.int64()), pa.array(weight - 1, pa.int64(), safe=False), pa.array(p), pa.array((p >= 0.5).astype("i4"))], names=["id", "line", "chars", "good", "label"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, line long, chars long, good double, label int").withColumnRenamed("id", id_col)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and score of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score_texts(b.column(1), model), pa.float64())], names=["id", "score"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, score double").withColumnRenamed("id", id_col)


def kept(docs: DataFrame, model: Model, threshold: float, text_col: str = "text") -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns, in one pass over them."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(score_texts(b.column(at), model) >= threshold))

    return docs.mapInArrow(run, docs.schema)
