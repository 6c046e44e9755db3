"""Chat formatting by prefix-target expansion.

Every assistant turn is the target of one example: all turns before it are context, written out before it, and
only its text is under the loss mask. Turns after the last reply make one more
example with nothing to train on, so that no turn is lost.

An example is written as pieces of about `PIECE` characters, which end between turns: those of ordinary
conversations are one row. A conversation of t turns has up to t prefixes, about t * t / 2 turns. Its pieces are made once,
by a group of a few turns each, and joined with the examples that hold them by conversation and piece,
so that a very long conversation is written by as many tasks as it has pieces, and no task holds more than one piece.

Where turns stand in their conversation (place, characters, examples before) is found in two steps: within ranges of the sorted turns,
then by sums over a conversation's ranges; a conversation that holds much of the table is many ranges. Only
the hash of all its turns is by nature the work of one task; it streams, and of earlier examples it sees the trained text alone.

Template: <|im_start|>role, newline, text, <|im_end|>, newline. In roles and texts a backslash
becomes two and the two characters that begin a control string get a backslash between
them (a newline in a role becomes backslash n), so control strings occur nowhere else and
reading gives back exactly what was written.

Defined results: null texts and roles are empty; turns are in the order of turn (null
first), then role, then text; repeated rows are turns of their own; rows without a
conversation id form one conversation with a null id; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm.shared import written

START, END = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"
#: Characters after which a piece ends with its turn.
PIECE = 1 << 16


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of each formatted turn."""
    out = []
    for turn in formatted.split(START)[1:]:
        role, _, body = turn.partition("\n")
        out.append((unescape(role), unescape(body.removesuffix(END))))
    return out


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv, position, segment (the formatted turn), size, at (characters before it in the conversation), body and body_size (of its text in the segment), reply, example (replies before it), turns (in the conversation)."""
    src = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    order = ["turn", "role", "text"]
    ranged = written(src.repartitionByRange("conv", *order).withColumn("part", F.spark_partition_id()), "ranged")
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\n")), F.lit("\n"))
    made = ranged.select("conv", "part", *order, head.alias("head"), escaped(F.col("text")).alias("body"), (F.col("role") == TRAINED).alias("reply"))
    made = made.select("conv", "part", *order, F.concat("head", "body", F.lit(END)).alias("segment"), F.char_length("head").alias("body_at"), F.char_length("body").alias("body_size"), "reply")
    made = made.withColumn("size", F.char_length("segment").cast("long"))
    before = Window.partitionBy("part", "conv").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = {"position": F.lit(1), "at": F.col("size"), "example": F.col("reply").cast("int")}
    placed = made.select("*", *[F.coalesce(F.sum(x).over(before), F.lit(0)).cast("long").alias(k) for k, x in sums.items()]).drop(*order)
    parts = ranged.groupBy("conv", "part").agg(F.count("*").alias("n"), F.count_if(F.col("role") == TRAINED).alias("replies"))
    sizes = made.groupBy("conv", "part").agg(F.sum("size").alias("chars"))
    same = lambda a, b: F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.part") == F.col(f"{b}.part"))
    ranges = parts.alias("p").join(sizes.alias("s"), same("p", "s")).select("p.*", "chars")
    earlier, whole = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("conv")
    offsets = ranges.select("conv", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("n", "chars", "replies")], F.sum("n").over(whole).alias("turns"))
    joined = placed.alias("a").join(offsets.alias("b"), same("a", "b"))
    return joined.select("a.conv", (F.col("position") + F.col("n_before")).alias("position"), "segment", "size", (F.col("at") + F.col("chars_before")).alias("at"), "body_at", "body_size", "reply", (F.col("example") + F.col("replies_before")).alias("example"), "turns")


def examples(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece: int = PIECE) -> DataFrame:
    """conv_col, example, piece, text, loss_start and loss_end (of the reply in the text, in its example's last piece), last (whether the example holds the whole conversation): all pieces of all examples."""
    held = written(segments(turns, conv_col, turn_col, role_col, text_col).withColumn("piece", F.floor(F.col("at") / piece)), "segments")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    pieces = held.groupBy("conv", "piece").agg(whole.alias("text"), F.min("at").alias("begins"))
    target = held.filter("reply or position = turns - 1").select("conv", "example", F.col("piece").alias("ends_in"), (F.col("at") + F.col("size")).alias("ends"), F.when(F.col("reply"), F.col("at") + F.col("body_at")).alias("loss"), "body_size", (F.col("position") == F.col("turns") - 1).alias("last"))
    wanted = target.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "ends_in"))).alias("w")
    met = wanted.join(pieces.alias("p").hint("merge"), F.col("w.conv").eqNullSafe(F.col("p.conv")) & (F.col("w.piece") == F.col("p.piece")))
    final = F.col("w.piece") == F.col("ends_in")
    start = F.when(final, F.col("loss") - F.col("begins"))
    text = F.when(final, F.substring("text", F.lit(1), (F.col("ends") - F.col("begins")).cast("int"))).otherwise(F.col("text"))
    return met.select(F.col("w.conv").alias(conv_col), "example", "w.piece", text.alias("text"), start.alias("loss_start"), (start + F.col("body_size")).alias("loss_end"), "last")


def texts(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """conv_col, example, text, loss_start, loss_end: each example in one row, with the span of its reply (null where nothing is trained)."""
    of = formatted.groupBy(conv_col, "example").agg(F.array_sort(F.collect_list(F.struct("piece", "text", "loss_start", "loss_end"))).alias("p"))
    before = F.aggregate(F.slice("p", 1, F.size("p") - 1), F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["text"]))
    final = F.element_at("p", -1)
    return of.select(conv_col, "example", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), (before + final["loss_start"]).alias("loss_start"), (before + final["loss_end"]).alias("loss_end"))


def digests(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read back from examples: conv_col, n_turns, turns_sha256 (of the example that holds the whole conversation), loss_chars, loss_sha256 (of what all masks cover), formatted_chars (of all examples), n_examples."""
    kind = formatted.schema[conv_col].dataType.simpleString()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    loss = F.substring("text", F.col("loss_start").cast("int") + 1, (F.col("loss_end") - F.col("loss_start")).cast("int"))
    # Of each piece only what the digests need moves: its size, the text under the mask, and all of it in the last example.
    slim = formatted.select(F.col(conv_col).alias("conv"), "example", "piece", F.char_length("text").cast("long").alias("chars"), F.when(F.col("loss_start").isNotNull(), loss).alias("loss"), F.when(F.col("last"), F.col("text")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, conv, found, last = False, None, [], None

        def out(id_type):
            made = pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], id_type), *[pa.array([x[i + 1] for x in found], k) for i, k in enumerate(kinds)]], names=["conv", *names])
            found.clear()
            return made

        turns = masked = None
        n = loss_chars = chars = count = 0
        for b in batches:
            for c, example, size, reply, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)), strict=True):
                if not begun or c != conv:
                    if begun:
                        found.append((conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars, count))
                    begun, conv, last, turns, masked = True, c, None, hashlib.sha256(), hashlib.sha256()
                    n = loss_chars = chars = count = 0
                count, last = count + (example != last), example
                chars += size
                if reply is not None:
                    reply = unescape(reply)
                    masked.update(reply.encode())
                    loss_chars += len(reply)
                for role, body in parse(text or ""):
                    turns.update(f"{role}\n{body}\n".encode())
                    n += 1
            yield out(b.column(0).type)
        if begun:
            found.append((conv, n, turns.hexdigest(), loss_chars, masked.hexdigest(), chars, count))
            yield out(b.column(0).type)

    dealt = slim.repartition("conv").sortWithinPartitions("conv", "example", "piece")
    return dealt.mapInArrow(run, f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long").withColumnRenamed("conv", conv_col)
