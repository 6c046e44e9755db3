"""Operators for training text against brute force, exact round trips, and the edge cases their docstrings define."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from netloom.llm import chat_format, decontaminate, html_text, line_crf, pivot_index, queries, sentencepiece_codec, shared, shingle_join, simhash, token_files, token_rollup, warc, wordcache
from netloom.llm.components import connected

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, ids string, score int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, extra columns with names of results."""
    rows = [(1, "Hello there world.", "en", "a", 3, "x", "y", 1), (1, "Hello there world.", "en", "a", 3, "x", "y", 1), (2, None, None, None, None, None, None, None), (3, "", "en", "a", 0, "", "", 0), (None, "null id", "en", None, 7, None, None, None), (4, "word " * 30_000, "en", "b", 1, "", "", 0), (5, " \n\t ", None, "b", 1, "", "", 0)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def random_texts(n, seed=1, alphabet="  aabcthe\n\t\xa0▁é日.,$# \U0001f600ing129<|>'"):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(n)] + ["", " ", "▁▁", "a" * 300, "   " * 40, "\n \n", "if (a){\n        return 1;\n}"]


def test_sentencepiece_equals_the_library():
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    mine, lib = sentencepiece_codec.SentencePieceCodec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in random_texts(1500):
        ids = lib.encode(text)
        assert mine.encode(text).tolist() == ids, repr(text)
        assert mine.decode(ids) == lib.decode(ids)
    r = random.Random(3)
    for _ in range(500):  # ids that no encoder gives
        ids = [r.randrange(3, 32000) if r.random() < 0.5 else r.randrange(3, 259) for _ in range(r.randrange(10))]
        assert mine.decode(ids) == lib.decode(ids)


def test_sentencepiece_frames(spark, odd, none):
    path = queries.tokenizer("piece_bpe_32k.model")
    got = sentencepiece_codec.encode(odd, path)
    assert got.count() == 7 and {r["doc_id"]: r["ids"] for r in got.collect()}[3] == []
    back = {r["doc_id"]: r["text"] for r in sentencepiece_codec.decode(got, path).collect()}
    assert back[4] == "word " * 30_000 and back[2] == "" and back[None] == "null id"
    digest = {r["doc_id"]: r for r in sentencepiece_codec.round_trip_digests(odd, path).collect()}
    assert digest[2]["n_tokens"] == 0 and digest[2]["ids_sha256"] == hashlib.sha256(b"").hexdigest()
    assert sentencepiece_codec.round_trip_digests(none, path).count() == 0


def test_byte_level_equals_the_library():
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    mine, lib = token_files.ByteBpe(path), Tokenizer.from_file(path)
    texts = [*random_texts(1500, 2), "it's we'll\nI'd 's", "<|endoftext|> a <|endoftext|>", "a <|endoftext|> b", "x\ny, z!\nÀ l'été:", " lead", "trail ", "\n", None, "end.\nNew “quotes”—dash"]
    ids, n = mine.encode_all(pa.array(texts, pa.string()))
    at = 0
    for text, k in zip(texts, n.tolist(), strict=True):
        want = lib.encode(text or "", add_special_tokens=False).ids
        assert ids[at : at + k].tolist() == want == mine.encode(text).tolist(), repr(text)
        at += k
    assert mine.encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def test_byte_level_blocks_and_long_texts(monkeypatch, sf):
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = queries.tokenizer("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), pq.read_table(f"{sf}/documents.parquet")["text"].combine_chunks()
    want = [e.ids for e in lib.encode_batch(texts.fill_null("").to_pylist(), add_special_tokens=False)]
    for block in (300, 8 << 20):
        monkeypatch.setattr(wordcache, "BLOCK", block)
        ids, n = token_files.ByteBpe(path).encode_all(texts)
        assert n.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_token_files_have_encodings_and_indexes(spark, sf):
    import glob

    import pyarrow.parquet as pq

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for delta in (False, True):
        out = shared.fresh_path(spark, "t")
        token_files.write(docs, out, queries.tokenizer("byte_bpe_50k.json"), delta=delta)
        seen = set()
        for f in glob.glob(out.removeprefix("file://") + "/part-*"):
            meta = pq.read_metadata(f)
            for g in range(meta.num_row_groups):
                for c in (meta.row_group(g).column(i) for i in range(meta.num_columns)):
                    assert c.has_column_index and c.has_offset_index
                    if c.path_in_schema.startswith("ids"):
                        seen |= set(c.encodings)
        assert ("DELTA_BINARY_PACKED" in seen) == delta and any("DICTIONARY" in e for e in seen) != delta


def test_token_files_of_one_id(spark):
    """Many rows of one id make several ranges."""
    rows = spark.createDataFrame([(7, "one two " * (i % 50)) for i in range(3000)], "doc_id long, text string").repartition(4)
    out = shared.fresh_path(spark, "t")
    token_files.write(rows, out, queries.tokenizer("byte_bpe_50k.json"))
    got = token_files.read(spark, out).select("start", "n_tokens", "part").orderBy("start").collect()
    assert len(got) == 3000 and all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(got, got[1:], strict=False))


def test_token_files(spark, odd, none):
    path = queries.tokenizer("byte_bpe_50k.json")
    tok = token_files.ByteBpe(path)
    for delta in (False, True):
        out = shared.fresh_path(spark, "t")
        token_files.write(odd, out, path, delta=delta)
        rows = token_files.read(spark, out).orderBy("start").collect()
        assert [r["id"] for r in rows] == [None, 1, 1, 2, 3, 4, 5]
        at = 0
        for r in rows:
            text = {1: "Hello there world.", 4: "word " * 30_000, 5: " \n\t ", None: "null id"}.get(r["id"], "")
            assert r["ids"] == [*tok.encode(text).tolist(), 0] and r["start"] == at and r["n_tokens"] == len(r["ids"])
            at += len(r["ids"])
        some = token_files.read(spark, out, 2, 3).collect()
        assert sorted(r["id"] for r in some) == [2, 3]
        d = {r["doc_id"]: r["ids_crc32"] for r in token_files.digests(token_files.read(spark, out)).collect()}
        assert d[2] == zlib.crc32(np.array([0], "<u4").tobytes())
    out = shared.fresh_path(spark, "t")
    token_files.write(none, out, path)
    assert token_files.read(spark, out).count() == 0 and token_files.metadata(spark, out).count() == 0


def brute_print(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(values, near):
    ids = sorted(values)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if near(values[a], values[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("hot", [128, 2])
def test_simhash_equals_brute_force(spark, sf, hot):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs, hot=hot).collect()}
    prints = {r["doc_id"]: brute_print(r["text"]) for r in docs.collect()}
    assert {i: format(x, "016x") for i, x in prints.items()} == {i: r["fingerprint"] for i, r in got.items()}
    want = brute_components(prints, lambda a, b: (a ^ b).bit_count() <= 2)
    assert want == {i: r["component_id"] for i, r in got.items()}


def test_pigeonring_links_all_pairs_of_a_dense_group(spark):
    r = random.Random(5)
    base = r.getrandbits(64)
    prints = {base}
    for _ in range(300):
        x = base
        for b in r.sample(range(64), r.randrange(5)):
            x ^= 1 << b
        prints.add(x)
    signed = {simhash._signed(x): x for x in prints}
    frame = spark.createDataFrame([(x,) for x in signed], "fp long")
    want = brute_components(signed, lambda a, b: (a ^ b).bit_count() <= 2)
    for hot in (128, 3):
        roots = {x["node"]: x["root"] for x in connected(simhash.links(frame, hot=hot)).collect()}
        assert {i: roots.get(i, i) for i in signed} == want


def test_simhash_odd_rows(spark, odd, none):
    got = simhash.near_duplicates(odd).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert len(got) == 7 and len(by[1]) == 2
    assert by[2][0]["fingerprint"] == "0" * 16 and by[2][0]["component_id"] == by[3][0]["component_id"] == by[5][0]["component_id"] == 2
    kept = simhash.one_of_each(odd).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"]) == [1, 2, 4] and simhash.near_duplicates(none).count() == 0


def test_one_of_each_without_unique_ids(spark):
    """Rows without an id, rows of one id with different texts, equal rows; columns with names the plan uses."""
    rows = [(1, "a b c d", 1), (None, "a b c d", 2), (None, "quite another text here", 3), (None, "and yet one more of them", 4), (3, "third text of its own", 5), (7, "third text of its own", 6), (7, "seven has this one too", 7), (7, "seven has this one too", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key int").withColumn("root", F.lit("r")).withColumn("_kept", F.lit(0))
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert collections.Counter((r["doc_id"], r["text"]) for r in kept.collect()) == collections.Counter([(1, "a b c d"), (None, "quite another text here"), (None, "and yet one more of them"), (3, "third text of its own"), (7, "seven has this one too")])
    whole = simhash.firsts(docs, shingle_join.rows_of(docs))
    assert collections.Counter((r["doc_id"], r["text"]) for r in whole.collect()) == collections.Counter((r["doc_id"], r["text"]) for r in kept.collect())


def test_components_of_a_chain(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b")
    assert {r["root"] for r in connected(links).collect()} == {0}
    assert connected(links.filter("a < 0")).count() == 0


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter("held_out").collect()
    assert len(got) > 50 and sum(r["predicted"] == r["quality"] for r in got) / len(got) > 0.95


def test_quality_odd_rows(spark, odd, none):
    model = line_crf.train(odd, spark.createDataFrame([(1, 1), (4, 0), (99, 1), (3, None)], "doc_id long, quality int"))
    got = line_crf.scored(odd, model).collect()
    assert len(got) == 7 and all(0 <= r["score"] <= 1 for r in got)
    assert line_crf.scored(none, model).count() == 0 and line_crf.kept(odd, model, 0.0).columns == odd.columns
    flat = line_crf.train(none, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in line_crf.scored(odd, flat).collect()} == {1.0}


def test_marginals_equal_enumeration():
    from itertools import product

    r = np.random.default_rng(1)
    u, steps, lines = r.normal(size=9), r.normal(size=4), np.array([4, 1, 3, 1])
    p, count, z = line_crf.marginals(u, steps, lines)
    want, at, total = np.zeros(9), 0, 0.0
    for n in lines:
        w = {s: np.exp(sum(u[at + i] * s[i] for i in range(n)) + sum(steps[2 * a + b] for a, b in zip(s, s[1:], strict=False))) for s in product((0, 1), repeat=int(n))}
        t = sum(w.values())
        total += np.log(t)
        for i in range(n):
            want[at + i] = sum(x for s, x in w.items() if s[i]) / t
        at += n
    assert np.allclose(p, want) and np.isclose(z, total) and np.isclose(count.sum(), (lines - 1).sum())


def test_long_chains_equal_short_ones():
    r = np.random.default_rng(3)
    lines = np.array([3, 700, 1, 40])
    u, steps = r.normal(size=lines.sum()) * 3, np.array([1.5, -1.2, -1.0, 1.4])
    assert np.allclose(line_crf.probabilities(u, steps, lines), line_crf.marginals(u, steps, lines)[0])
    far = np.concatenate([np.full(400, 900.0), np.full(400, -900.0)])
    p = line_crf.probabilities(far, steps, np.array([800]))
    assert np.isfinite(p).all() and p[:300].min() > 0.99 and p[500:].max() < 0.01


def test_potentials_equal_figures_times_weights(monkeypatch):
    texts = pa.array(["one\ntwo, words 12!\n", "", "Ünï\n\nx" * 40, "a", "long " * 3000 + "\nend"])
    w = np.random.default_rng(4).normal(size=line_crf.WIDTH)
    for block in (1 << 20, 100):
        monkeypatch.setattr(line_crf, "BLOCK", block)
        figures, weight, lines = line_crf.line_figures(*line_crf._bytes_of(texts))
        own, weight2, lines2 = line_crf.own_figures(*line_crf._bytes_of(texts))
        assert np.allclose(line_crf.potentials(own, lines, w), figures @ w, atol=1e-4) and np.array_equal(weight, weight2) and np.array_equal(lines, lines2)
        assert weight.sum() - len(weight) == sum(len(x) for t in texts.to_pylist() for x in t.split("\n"))


def test_lines_of_a_mixed_document_differ(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = queries.quality_model(spark, docs, folder)
    assert np.abs(model.steps).max() <= line_crf.STEP
    held = docs.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").filter(queries.held_out(F.col("doc_id")) & (F.size(F.split("text", "\n")) >= 5)).orderBy("doc_id")
    good, bad = (held.filter(f"quality = {q}").first()["text"].split("\n")[:5] for q in (1, 0))
    mixed = spark.createDataFrame([(1, "\n".join(good + bad + good), "x"), (2, None, "y"), (2, None, "y")], "doc_id long, text string, good string")
    got = line_crf.line_labels(mixed, model).collect()
    lines = [r["label"] for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["line"])]
    assert lines[1:4] == [1, 1, 1] and lines[6:9] == [0, 0, 0] and lines[11:14] == [1, 1, 1] and len(got) == 17
    flat = line_crf.scored(mixed, model).filter("doc_id = 1").first()["score"]
    p = [(r["good"], r["chars"] + 1) for r in got if r["doc_id"] == 1]
    assert abs(flat - sum(a * b for a, b in p) / sum(b for _, b in p)) < 1e-9


def test_line_figures_do_not_depend_on_neighbouring_documents():
    texts = ["one\ntwo words\n", "", "Ünï\n\nx", "a"]
    column = pa.array(texts)
    values, starts, ends = line_crf._bytes_of(column)
    together, _, lines = line_crf.line_figures(values, starts, ends)
    alone = [line_crf.line_figures(*line_crf._bytes_of(pa.array([t])))[0] for t in texts]
    assert lines.tolist() == [3, 1, 3, 1] and np.allclose(together, np.concatenate(alone))


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p><p>no";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=1>Menu</a></ul></nav>
<div class="ad">Buy, now. Cheap.</div><article><header><h1>Title</h1></header><p>First &amp; <b>bold</b>&nbsp;text.<p>Second
 line<br>goes on.</p><!-- no --><p>C</p><aside>Aside text.</aside><div class="comments"><p>Nice one, really.</p></div></article><form><p>Form.</p></form><footer>&copy; x</footer>"""


def test_html(spark):
    assert html_text.main_text(PAGE) == "Title\nFirst & bold text.\nSecond line goes on.\nC"
    plain = '<body><div class=top><a href=1>Home</a> <a href=2>News</a></div><div><p>A long paragraph of text, with marks. It goes on.</p><p>Short.</p><p>Another long paragraph of text; and so on, it seems.</p></div><div class="sidebar"><p>Side text is here, too.</p></div>'
    assert html_text.main_text(plain).split("\n")[1] == "Short." and "Side" not in html_text.main_text(plain) and "Home" not in html_text.main_text(plain)
    rows = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (2, None, "", "x"), (None, "v", "<p>a<script>never closed", "x")], "page_id long, url string, html string, text string")
    got = {(r["page_id"], r["url"]): r for r in html_text.extract(rows).collect()}
    assert got[(2, None)]["text"] == "" and got[(1, "u")]["n_chars"] == len(html_text.main_text(PAGE)) and html_text.extract(rows).count() == 4
    assert html_text.extract(rows.limit(0)).count() == 0


def _page(i, r):
    """A page, and the lines of its article."""
    sentence = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet consectetur adipiscing elit".split()) for _ in range(n)).capitalize() + "."
    lines = [sentence(3), *[sentence(r.randrange(4, 60)) for _ in range(r.randrange(2, 8))]]
    items = [sentence(2) for _ in range(3)]
    body = f"<h1>{lines[0]}</h1>" + "".join(f"<p>{x.replace('dolor', '<b>dolor</b>')}</p>" for x in lines[1:]) + "<ul>" + "".join(f"<li>{x}" for x in items) + "</ul>"
    around = ['<div class="sidebar"><p>{}</p></div>', '<div id="cookie-notice"><p>{}</p></div>', "<aside><p>{}</p></aside>", '<section class="comments"><p>{}</p><p>Me too, I say; yes.</p></section>', "<form><label>{}</label><input></form>", '<div style="display: none">{}</div>', "<p hidden>{}</p>", '<div class="ad-slot">{}</div>']
    r.shuffle(around)
    wrap = ["<article>{}</article>", "<main><div class=text>{}</div></main>", '<div role="main">{}</div>'][i % 3]
    links = "<nav><ul>" + "".join(f'<li><a href="/{k}">Link {k}</a>' for k in range(6)) + "</ul></nav>"
    side = [x.format(sentence(r.randrange(3, 40))) for x in around]
    return f"<html><head><title>x</title><style>p{{}}</style></head><body><header><h1>Site</h1></header>{links}{''.join(side[:4])}{wrap.format(body)}{''.join(side[4:])}<footer>&copy; 2000</footer></body></html>", lines + items


def test_html_of_made_pages():
    r = random.Random(6)
    for i in range(60):
        page, lines = _page(i, r)
        assert html_text.main_text(page).split("\n") == lines


def test_html_values_equal_plain_loops():
    """Ratios by path, smoothed, fused, weighted: the same with loops over blocks."""
    r = random.Random(7)
    for i in range(20):
        blocks = html_text.Page(_page(i, r)[0] if i % 2 else "<div><p>One, two.<p>Three <a>four</a></div><ul><li><a>x</a><li><a>yy</a> z</ul><p>Five; six, and seven.").blocks
        by = collections.defaultdict(list)
        for path, text, linked, _ in blocks:
            by[path].append((len(text), linked, sum(c in ".,;:!?" for c in text)))
        ratio = [sum(n - k for n, k, _ in by[b[0]]) / len(by[b[0]]) for b in blocks]
        marks = [sum(m for _, _, m in by[b[0]]) / len(by[b[0]]) for b in blocks]
        smooth = lambda x: [(x[max(j - 1, 0)] + 2 * x[j] + x[min(j + 1, len(x) - 1)]) / 4 for j in range(len(x))]
        fused = [a * (html_text.BASE + b) for a, b in zip(smooth(ratio), smooth(marks), strict=True)]
        best = max([x[3] for x in blocks if x[3] and len(x[1]) > x[2]], default=1)
        want, total, size = [], 0, 0
        for path, text, _, region in blocks:
            mean = sum(f for f, b in zip(fused, blocks, strict=True) if b[0] == path) / len(by[path])
            mean *= max(0, 1 - sum(k for _, k, _ in by[path]) / sum(n for n, _, _ in by[path]) / html_text.LINKED)
            if region == best:
                total, size = total + mean * len(text), size + len(text)
            want.append(mean * (1 if region == best else html_text.LESS if region else html_text.LESS**2))
        got, least = html_text.values(blocks)
        assert np.allclose(got, want) and np.isclose(least, html_text.SHARE[best] * total / size)


def test_html_takes_linear_time():
    import time

    for part in ("<a ", "<div><center>", '<p class="x>', "<!--", "<span hidden>", "<li>", "</div>", "<", "<a b='", "<tr><td>", "<script>", "word "):
        began = time.process_time()
        html_text.main_text(part * (500_000 // len(part)))
        assert time.process_time() - began < 3, part


def test_warc(spark):
    big = "é" * 700
    rows = [(1, "http://a/\n", big), (2, None, big), (3, "u", "small"), (4, "u", "small"), (None, "n", big), (5, "v", None), (6, "w", big), (6, "w", big)]
    rows.append((7, "x", "long line " * 300_000))
    pages = spark.createDataFrame([(*x, "d", 1) for x in rows], "page_id long, url string, html string, digest string, offset int")
    folder = shared.fresh_path(spark, "warc")
    index = warc.write(pages, folder, archive=400)
    assert index.count() == 9 and index.select("file").distinct().count() > 1
    got = warc.read(index).collect()
    kinds = collections.Counter((r["id"], r["record_type"], r["refers_to"]) for r in got)
    assert kinds == {(1, "revisit", 6): 1, (2, "revisit", 6): 1, (3, "response", None): 1, (4, "response", None): 1, (None, "response", None): 1, (5, "response", None): 1, (6, "response", None): 2, (7, "response", None): 1}
    for r in got:
        text = dict((i, h) for i, _, h in rows)[r["id"]] or ""
        assert r["payload_bytes"] == len(text.encode()) and r["payload_digest"] == hashlib.sha1(text.encode()).hexdigest()
        assert r["record_type"] == "revisit" or bytes(r["payload"]) == text.encode()
    open(f"{folder.removeprefix('file://')}/archives/left-behind.warc.gz", "wb").close()
    assert warc.vacuum(spark, folder) == 1 and warc.vacuum(spark, folder) == 0 and warc.read(index).count() == 9
    some = warc.read(index.filter("id = 3")).collect()
    assert len(some) == 1 and bytes(some[0]["payload"]) == b"small"
    assert warc.read(warc.write(pages.limit(0), shared.fresh_path(spark, "warc"))).count() == 0
    assert warc.coalesced([("f", 0, 10), ("f", 12, 5), ("f", 100, 5), ("g", 105, 5)], 5, 50) == [("f", 0, 17, 2), ("f", 100, 5, 1), ("g", 105, 5, 1)]


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + r.normal(size=16) * (0.05 if i >= 40 else 0)).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 3), (2004, [*rows[0][1][:15], None])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if i < 2000}
    pairs = {(a, b) for a in ok for b in ok if a < b and ok[a] @ ok[b] >= 0.95}
    degree = collections.Counter(x for p in pairs for x in p)
    for block in (1500, 20):
        got = {x["vec_id"]: x for x in pivot_index.near_duplicates(frame, block=block).collect()}
        found = sum(got[i]["n_links"] for i in ok)
        assert found >= 0.9 * 2 * len(pairs) and all(got[i]["n_links"] <= degree[i] for i in ok)
        assert got[1000]["component_id"] == got[3]["component_id"] and got[3]["n_links"] >= 5
        assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in range(2000, 2005))
    assert pivot_index.near_duplicates(frame.limit(0)).count() == 0


def windows_brute(text, item):
    import re

    words = lambda t: [w for w in re.split(r"[\W_]+", t.lower()) if w]
    d, i = words(text or ""), words(item or "")
    if not d or not i:
        return 0
    k, n = min(5, len(i)), min(len(i), len(d))
    grams = lambda w: collections.Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
    want, best = grams(i), 0
    for s in range(max(len(d) - len(i), 0) + 1):
        g = grams(d[s : s + n])
        both, all_ = sum((g & want).values()), sum((g | want).values())
        best = max(best, both / all_ if all_ else 0)
    return best


def test_decontamination_equals_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choice(vocab) for _ in range(n)) for n in (40, 25, 40, 70, 3, 1)] + ["", None]
    docs = []
    for i in range(60):
        text = [r.choice(vocab) for _ in range(r.randrange(150))]
        if i % 2:
            w = items[i % 4].split()
            for _ in range(r.randrange(3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            text[5:5] = w[r.randrange(4) :]
        docs.append((i, ", ".join(text).upper() if i % 3 == 0 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, items[0][: len(items[0]) - 6]), (None, items[1]), (103, items[4]), (103, items[4])]
    d = spark.createDataFrame([(a, b, 1.0) for a, b in docs], "doc_id long, text string, _bad double")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for a, t in docs:
        for j, item in enumerate(items):
            if (s := windows_brute(t, item)) >= 0.8:
                want[(a, j)] = round(s, 9)
    got = {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in decontaminate.matches(d, b).collect()}
    assert got == want and len(want) > 15
    assert {x["doc_id"] for x in decontaminate.clean(d, b).collect()} == {a for a, _ in docs} - {a for a, _ in want}
    assert decontaminate.matches(d.limit(0), b).count() == 0 and decontaminate.matches(d, b.limit(0)).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b\\<|x|>\\n"), (1, 2, "user", queries.TRICKY), (1, 3, "assistant", "<"), (1, 4, "user", None), (2, 0, "system", "only"), (None, None, None, None), (3, 0, "assistant", ""), (3, 0, "assistant", ""), (4, 0, "us\ner", "|>")]
    turns = spark.createDataFrame([(*x, 9) for x in rows], "conv_id long, turn long, role string, text string, n_turns int")
    turns = turns.withColumn("piece", F.lit(0)).withColumn("last", F.lit(True))
    for size in (1 << 16, 20):
        done = shared.written(chat_format.examples(turns, piece=size), "chats")
        got = {r["conv_id"]: r for r in chat_format.digests(done).collect()}
        texts = {(x["conv_id"], x["example"]): x for x in chat_format.texts(done).collect()}
        for c in (1, 2, 3, 4, None):
            mine = [(ro or "", t or "") for i, _, ro, t in rows if i == c]
            assert got[c]["n_turns"] == len(mine) and got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in mine).encode()).hexdigest()
            loss = "".join(b for a, b in mine if a == "assistant")
            assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
            # Every reply's example holds all turns before it, and its mask just the reply.
            ends = [i for i, (role, _) in enumerate(mine) if role == "assistant"]
            examples = [texts[k] for k in sorted((k for k in texts if k[0] == c), key=lambda k: k[1])]
            assert len(examples) == len(ends) + (mine[-1][0] != "assistant") == got[c]["n_examples"]
            for x, end in zip(examples, [*ends, len(mine) - 1], strict=False):
                assert chat_format.parse(x["text"]) == mine[: end + 1]
                masked = None if x["loss_start"] is None else chat_format.unescape(x["text"][x["loss_start"] : x["loss_end"]])
                assert masked == (mine[end][1] if mine[end][0] == "assistant" else None)
            assert sum(len(x["text"]) for x in examples) == got[c]["formatted_chars"]
    assert chat_format.digests(chat_format.examples(turns.limit(0))).count() == 0


def test_chat_of_one_long_conversation(spark):
    """In many ranges and pieces."""
    rows = [(5, i, "assistant" if i % 2 else "user", f"turn {i} " + "é" * (i % 40)) for i in range(400)]
    done = shared.written(chat_format.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4), piece=500), "chats")
    got = chat_format.digests(done).collect()
    assert len(got) == 1 and got[0]["n_turns"] == 400 and got[0]["n_examples"] == 200
    assert got[0]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for _, _, r, t in rows).encode()).hexdigest()
    assert got[0]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in rows if r == "assistant").encode()).hexdigest()
    whole = "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, _, r, t in rows)
    assert [x["text"] for x in chat_format.texts(done).orderBy("example").collect()] == [whole[: whole.index(f"<|im_start|>user\nturn {2 * k + 2} ") if k < 199 else None] for k in range(200)]


def _totals(roll):
    return {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in roll.totals().collect()}


def test_rollup_equals_recount(spark, odd, none):
    roll = token_rollup.Rollup(spark, shared.fresh_path(spark, "roll"))
    assert roll.totals().count() == 0
    versions = {"w": "words", "b": queries.tokenizer("byte_bpe_50k.json"), "p": queries.tokenizer("piece_bpe_32k.model")}
    counts = shared.written(token_rollup.counted(odd.select("doc_id", "source", "lang", "text", F.lit(3).alias("counts")), versions), "counts")
    assert counts.columns == ["doc_id", "source", "lang", "counts"]
    assert roll.commit("1", token_rollup.inserts(counts)) and not roll.commit("1", token_rollup.inserts(counts))
    assert roll.commit("", token_rollup.inserts(counts.limit(0))) and not roll.commit("", token_rollup.inserts(counts))
    before = counts.filter("doc_id = 4")
    after = before.withColumn("lang", F.lit("de")).withColumn("counts", F.transform_values("counts", lambda k, v: v - 1))
    assert roll.commit("2", token_rollup.revisions(before, after)) and roll.commit("3", token_rollup.deletes(counts.filter("doc_id = 1")))
    want = _totals(roll)
    assert want[("b", "de", "w")] == (1, 29_999) and ("b", "en", "w") not in want and want[(None, "en", "w")] == (1, 2) and want[("a", "en", "w")] == (1, 0)
    assert roll.compact() and _totals(roll) == want and not roll.commit("2", token_rollup.deletes(counts)) and _totals(roll) == want
    assert roll.vacuum() == 4 and _totals(roll) == want and not roll.commit("2", token_rollup.deletes(counts)) and roll.committed("")
    assert token_rollup.counted(none.select("doc_id", "source", "lang", "text"), versions).count() == 0


def test_rollup_survives_dead_and_rival_drivers(spark):
    rows = spark.createDataFrame([("s", "en", {"w": 5}), ("s", "en", {"w": 5})], "source string, lang string, counts map<string,bigint>")
    folder = shared.fresh_path(spark, "roll")
    one, two = token_rollup.Rollup(spark, folder), token_rollup.Rollup(spark, folder)
    key = ("s", "en", "w")

    class Died(Exception):
        pass

    def dies(name, marker):
        p, fs = one._path(f"commits/_{name}")
        fs.create(p, False).close()
        raise Died

    one._mark = dies  # between the file's creation and its content
    with pytest.raises(Died):
        one.commit("a", token_rollup.inserts(rows))
    assert _totals(two) == {} and two.commit("a", token_rollup.inserts(rows)) and _totals(two) == {key: (2, 10)}
    del one._mark
    assert not one.commit("a", token_rollup.inserts(rows)) and one.commit("b", token_rollup.inserts(rows))
    # Two compactions of one state, and one of an older state that ends late.
    state, sums = one._live()[0], one._sums(one._live()[0])
    late = one._sums(state)
    assert one._write("sum of 1", sums, ["a", "b"]) and two._write("sum of 2", sums, ["a", "b"]) and _totals(one) == {key: (4, 20)}
    assert one.commit("c", token_rollup.deletes(rows)) and one.compact() and two._write("sum of 3", late, ["a", "b"]) and _totals(two) == {key: (2, 10)}
    # Two drivers at one batch, neither of which sees the other before it has written.
    two.committed = one.committed = lambda batch: False
    done = [one.commit("d", token_rollup.inserts(rows)), two.commit("d", token_rollup.inserts(rows))]
    assert any(done) and _totals(one) == {key: (4, 20)}
    one.vacuum()
    assert _totals(two) == {key: (4, 20)}


def test_rollup_query_equals_recount(spark, sf, tmp_path):
    """Both versions, the byte-level one by the library; rows without an id, with one id and with one text."""
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.tokenizer("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(None, "x y\nx y\nz", "en", "a", 1), (None, "x y\nx y\nz", "en", "b", 1), (None, "alone", "en", "b", 1), (5, "new text", "en", "b", 1), (5, "new text", "en", "b", 1), (None, None, None, None, None), (6, "", "en", "b", 0)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string, n_chars long").select(*[F.col(f.name).cast(f.dataType) for f in docs.schema])).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in queries.op10_token_rollup(spark, str(tmp_path)).collect()}
    first, want = {}, collections.defaultdict(lambda: [0, 0])
    for r in sorted(spark.read.parquet(f"{tmp_path}/documents.parquet").collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["source"] or "", r["lang"] or "")):
        if (r["text"] or "") not in first:
            first[r["text"] or ""] = 1
            text = "\n".join(dict.fromkeys((r["text"] or "").split("\n")))
            for version, n in (("words", len(text.split())), ("byte_bpe_50k", len(lib.encode(text, add_special_tokens=False).ids))):
                want[(r["source"], r["lang"], version)][0] += 1
                want[(r["source"], r["lang"], version)][1] += n
    assert got == {k: tuple(v) for k, v in want.items()}


def test_pipeline_stages(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf), "stage")
        assert docs.columns == columns
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert ids < kept
        kept = ids
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in last.collect()} == kept
