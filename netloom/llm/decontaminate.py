"""Passages of benchmark items in documents, by SimHash windows; DataFrame operations only.

Texts become words (lower case, runs of letters, marks and digits) and shingles of `width`
words (all words, where an item has fewer). A document's window of an item's size matches the
item if the weighted Jaccard similarity of their shingles, weighted by how often each occurs,
reaches `least`.

1. Anchors. A window that similar lacks at most a known number d of the item's
   shingles, so that it holds one of any d + 1. Documents' shingles are looked up among d + 1 shingles
   of each item. This loses nothing, and text without an anchor goes no further. The scan tests shingles against a bitmap of
   the anchors, of a fixed size; what passes is joined with the anchors themselves.
2. Windows. Every window of the item's size that covers an anchor gets a SimHash of 64 bits;
   its bits are summed in lanes of long integers, 32 sums for 64 counters.
3. Multi-index Hamming search. Fingerprints are cut into 4 blocks of 16 bits. Within a
   radius of 23 bits some block differs in at most 5, so an item is listed under all values of each
   block within 5 bits, for windows of its size, and every fingerprint within the radius is met. At a
   similarity of 0.8 two fingerprints differ in 9.7 bits on average, with a standard
   deviation of 2.9: the radius lies 4.8 deviations above. Those of few shingles differ more (5 of which 4 are in common: 12, deviation 3.1),
   so that items of up to 8 shingles have blocks within 6 bits and a radius of 27.
4. Exact similarity of the candidates, from their words.

Documents with no anchor cost one pass; what follows is in proportion to the passages found.
A passage in very many documents makes as many rows as there are documents, keyed by document.

Defined results: null or empty texts and items match nothing; a document shorter than
an item is one window; of rows that repeat an id the best window counts; rows without an id
are reported together with a null id, and clean() drops just those with a match; of items that repeat an id, each text counts; items
without an id are reported with a null one; extra columns are not read; ties go to the first window.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.llm.shared import bitmap, passes, text_key, without, written

WIDTH, LEAST = 5, 0.8
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 4, 16, 5
#: Items of so few shingles, and the radius of their blocks.
SHORT, SHORT_RADIUS = 8, 6
NOT_WORD = r"[^\p{L}\p{M}\p{N}]+"


def words(text: Column) -> Column:
    """array<string>; one empty string if there is no word."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), NOT_WORD, " ")), " ")


def hashes(w: Column, width: int) -> Column:
    """A hash by position of each shingle of so many words. w is bound once, whatever expression it is: the optimizer may put it in place of a column."""

    def of(v: Column) -> Column:
        every = F.transform(v, lambda x, i: F.xxhash64(x, *[F.get(v, i + k) for k in range(1, width)]))
        return F.slice(every, 1, F.greatest(F.size(v) - (width - 1), F.lit(0)))

    return F.element_at(F.transform(F.array(w), of), 1)


def shingle(w: Column, at: Column, width: int) -> Column:
    return F.array_join(F.slice(w, at + 1, width), " ")


def _lanes(h: Column) -> list[Column]:
    """Sums over rows of each bit: 64 counters in 32 longs."""
    return [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(0x0000000100000001))).alias(f"lane{i}") for i in range(32)]


def _fingerprint(n: Column) -> Column:
    """Of the lanes: a bit is 1 if it is set in over half the n hashes."""
    bits = F.lit(0).cast("long")
    for i in range(32):
        low, high = F.col(f"lane{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(F.col(f"lane{i}"), 32)
        bits = bits.bitwiseOR(F.when(low * 2 > n, F.lit(1 << i)).otherwise(F.lit(0).cast("long")))
        top = (1 << (i + 32)) - (1 << 64 if i == 31 else 0)
        bits = bits.bitwiseOR(F.when(high * 2 > n, F.lit(top)).otherwise(F.lit(0).cast("long")))
    return bits


def _block(fp: Column, b: int) -> Column:
    return F.shiftrightunsigned(fp, b * BLOCK_BITS).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1))


def _matched(docs: DataFrame, items: DataFrame, least: float, width: int, id_col: str, text_col: str, item_col: str, item_text: str) -> DataFrame | None:
    """id, row (hash of the text), item, n, start, similarity of all windows that match; None if no item has a word."""
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")
    item = items.select(F.col(item_col).alias("name"), words(F.col(item_text)).alias("w")).filter("w[0] <> ''").distinct()
    item = written(item.select(F.monotonically_increasing_id().alias("item"), "name", "w", F.size("w").alias("n"), F.least(F.size("w"), F.lit(width)).alias("k")), "items", short=True)
    widths = [r["k"] for r in item.select("k").distinct().orderBy("k").collect()]  # at most `width` numbers
    if not widths:
        return None

    by_width = [(k, item.filter(F.col("k") == k).select("item", "n", "w", hashes(F.col("w"), k).alias("h"))) for k in widths]
    anchors = None
    for k, x in by_width:
        m = F.col("n") - (k - 1)
        most = m - F.ceil(m * least - 1e-9)  # shingles that may be missing, from a document shorter than the item too
        one = x.select("item", "n", F.lit(k).alias("k"), F.explode(F.slice(F.array_sort(F.array_distinct("h")), 1, (most + 1).cast("int"))).alias("h"))
        anchors = one if anchors is None else anchors.unionAll(one)
    anchors = written(anchors, "anchors", short=True)
    bits = bitmap(anchors, F.col("h"))
    known = text.withColumn("row", text_key(F.col("text"))).withColumn("w", words(F.col("text"))).withColumn("bitmap", bits.scalar())
    holds = reduce(Column.__or__, [F.exists(hashes(F.col("w"), k), lambda h: passes(h, F.col("bitmap"))) for k in widths])
    suspects = written(written(known.filter(holds).select("id", "row", "w"), "found").dropDuplicates(["id", "row"]), "suspects", short=True)

    def met(k: int) -> DataFrame:
        a = anchors.filter(F.col("k") == k).select("n", "h").distinct()
        found = suspects.select("id", "row", F.size("w").alias("size"), F.posexplode(hashes(F.col("w"), k)).alias("at", "h"))
        return found.withColumn("bitmap", bits.scalar()).filter(passes(F.col("h"), F.col("bitmap"))).join(a, "h").select("id", "row", "size", F.lit(k).alias("k"), "n", "at", "h")

    found = written(reduce(DataFrame.unionAll, [met(k) for k in widths]), "anchored", short=True)
    hit_items = anchors.join(found.select("k", "n", "h").distinct(), ["k", "n", "h"], "left_semi").select("item").distinct()
    # Starts of the windows of n words that cover an anchor; a shorter document is one window.
    last = F.greatest(F.col("size") - F.col("n"), F.lit(0))
    starts = F.sequence(F.least(F.greatest(F.col("at") + F.col("k") - F.col("n"), F.lit(0)), last), F.least(F.col("at"), last))
    hits = written(found.select("id", "row", "size", "k", "n", F.explode(starts).alias("start")).distinct(), "windows", short=True)
    same_row = lambda a, b: F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id")) & (F.col(f"{a}.row") == F.col(f"{b}.row"))

    # Fingerprints of windows and of items.
    prints, item_prints = None, None
    for k, x in by_width:
        held = suspects.select("id", "row", hashes(F.col("w"), k).alias("h"))
        m = F.least(F.col("n"), F.col("size")) - (k - 1)
        open_ = hits.filter(F.col("k") == k).alias("a").join(held.alias("b"), same_row("a", "b")).select("a.*", "b.h").select("id", "row", "k", "n", "start", m.alias("m"), F.explode(F.slice("h", F.col("start") + 1, m)).alias("h"))
        one = open_.groupBy("id", "row", "k", "n", "start", "m").agg(*_lanes(F.col("h"))).select("id", "row", "k", "n", "start", "m", _fingerprint(F.col("m")).alias("fp"))
        prints = one if prints is None else prints.unionAll(one)
        own = x.select("item", "n", F.size("h").alias("m"), F.explode("h").alias("h")).groupBy("item", "n", "m").agg(*_lanes(F.col("h"))).select("item", F.lit(k).alias("k"), "n", _fingerprint(F.col("m")).alias("item_fp"))
        item_prints = own if item_prints is None else item_prints.unionAll(own)
    prints = written(prints, "prints", short=True)

    # Multi-index search: an item under all values within its radius of each block.
    def around(value: str) -> Column:
        every = F.sequence(F.lit(0).cast("long"), F.lit((1 << BLOCK_BITS) - 1).cast("long"))
        flips = F.when(F.col("radius") == BLOCK_RADIUS, F.filter(every, lambda x: F.bit_count(x) <= BLOCK_RADIUS)).otherwise(F.filter(every, lambda x: F.bit_count(x) <= SHORT_RADIUS))
        return F.transform(flips, lambda f: f.bitwiseXOR(F.col(value)))

    radius = F.when(F.col("n") - (F.col("k") - 1) <= SHORT, SHORT_RADIUS).otherwise(BLOCK_RADIUS).alias("radius")
    listed = item_prints.join(hit_items, "item", "left_semi").select("item", "k", "n", "item_fp", radius, F.posexplode(F.array(*[_block(F.col("item_fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    listed = listed.select("item", "k", "n", "item_fp", "radius", "block", F.explode(around("value")).alias("value"))
    keyed = prints.select("id", "row", "k", "n", "start", "m", "fp", F.posexplode(F.array(*[_block(F.col("fp"), b) for b in range(BLOCKS)])).alias("block", "value"))
    apart = F.col("fp").bitwiseXOR(F.col("item_fp"))
    first = F.coalesce(*[F.when(F.bit_count(_block(apart, b)) <= F.col("radius"), F.lit(b)) for b in range(BLOCKS)])
    candidates = keyed.join(listed.hint("merge"), ["k", "n", "block", "value"]).filter((F.bit_count(apart) <= (F.col("radius") + 1) * BLOCKS - 1) & (first == F.col("block"))).select("id", "row", "k", "n", "start", "m", "item")

    # Exact weighted similarity of their shingles.
    total = None
    for k, x in by_width:
        own = x.select("item", F.size("h").alias("item_m"), F.explode(F.transform(F.sequence(F.lit(0), F.size("h") - 1), lambda i: shingle(F.col("w"), i, k))).alias("s")).groupBy("item", "item_m", "s").agg(F.count("*").alias("item_n"))
        # The window's shingles that are among the item's are at least as many as both have in common.
        near = candidates.filter(F.col("k") == k).join(x.select("item", F.col("h").alias("item_h")), "item").alias("a").join(suspects.alias("b"), same_row("a", "b"))
        upto = F.size(F.filter(hashes(F.slice("b.w", F.col("a.start") + 1, F.col("a.m") + (k - 1)), k), lambda h: F.array_contains(F.col("a.item_h"), h)))
        near = near.withColumn("upto", upto).filter(F.col("upto") >= (F.col("a.m") + F.size("a.item_h") - F.col("upto")) * least)
        held = near.select("a.id", "a.row", "a.item", "a.n", "a.start", "a.m", F.explode(F.transform(F.sequence(F.col("a.start"), F.col("a.start") + F.col("a.m") - 1), lambda i: shingle(F.col("b.w"), i, k))).alias("s"))
        counted = held.groupBy("id", "row", "item", "n", "start", "m", "s").agg(F.count("*").alias("doc_n"))
        common = counted.join(own, ["item", "s"]).groupBy("id", "row", "item", "n", "start", "m", "item_m").agg(F.sum(F.least("doc_n", "item_n")).alias("both"))
        total = common if total is None else total.unionAll(common)
    similarity = F.col("both").cast("double") / (F.col("m") + F.col("item_m") - F.col("both")).cast("double")
    good = total.select("id", "row", "item", "start", "n", similarity.alias("similarity")).filter(F.col("similarity") >= least)
    return good.join(item.select("item", "name"), "item").select("id", "row", F.col("name").alias("item"), "n", "start", "similarity")


def matches(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """id_col, item_col, similarity, start_word, n_words: the best window of each document and item that match."""
    good = _matched(docs, items, least, width, id_col, text_col, item_col, item_text)
    if good is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, `{item_col}` {items.schema[item_col].dataType.simpleString()}, similarity double, start_word int, n_words int")
    best = good.groupBy("id", "item", "n").agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    return best.select(F.col("id").alias(id_col), F.col("item").alias(item_col), "best.similarity", (-F.col("best.back")).alias("start_word"), F.col("n").alias("n_words"))


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs that have no match; of rows that repeat an id, those with a match of their own go."""
    good = _matched(docs, items, least, width, id_col, text_col, item_col, item_text)
    if good is None:
        return docs
    return without(docs, written(good.select("id", F.col("row").alias("key")).distinct(), "leaks", short=True), id_col, text_col)
