"""Archives: payloads that no other row has don't move, and index rows go to few files."""

import glob

from netloom.llm import shared, warc


def test_only_revisits_move(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 40 if i < 120 else i}</p>" * 200) for i in range(400)] + [(None, None, "<p>1</p>" * 200), (500, "u", "<p>1</p>" * 200), (500, "u", "<p>1</p>" * 200), (501, None, None), (502, "short", "a"), (503, "short", "a")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2)
    folder = shared.fresh_path(spark, "warc")
    parts, was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index = warc.write(pages, folder)
        got = warc.read(index).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was)
    # Two tasks scan, eight have what is joined: not one file for each partition of a shuffle of all payloads.
    assert len(glob.glob(f"{folder.removeprefix('file://')}/index/part-*")) <= 10
    html = {}
    for i, _, t in rows:
        html.setdefault(t or "", []).append(i)
    assert len(got) == len(rows)
    for r in got:
        text = next(t for t in html if r["id"] in html[t] and len(t) == r["payload_bytes"] and (r["payload"] is None or bytes(r["payload"]).decode() == t))
        newest = max((x for x in html[text] if x is not None), default=None)
        stored = len(text) < 1000 or r["id"] is None or r["id"] == newest
        assert (r["record_type"], r["refers_to"]) == (("response", None) if stored else ("revisit", newest))
