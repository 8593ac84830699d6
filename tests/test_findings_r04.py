"""What the review of round 4 found in the core: a step that was computed many times over."""

import hashlib


def test_blocks_of_a_page_are_made_once(spark, tmp_path):
    """A filter that Spark infers of an inner posexplode held some 40 copies of all that makes the blocks."""
    from quillspark.plans import catalog

    page = "<html><body><h1>Chapter 1</h1><p> “Go,”﻿ he [1] said. [2] </p><p>12</p><p>- no</p><p>Long <b>and</b> wide </p></body></html>"
    rows = [(1, "https://a.example/1", page), (2, "https://a.example/2", "<html><body></body></html>"), (3, "https://a.example/3", None), (4, "https://b.example/1", "<html><body><p>A.</p></body></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.queries()["F1_F5_F6_page_blocks"](spark, str(tmp_path))
    texts = [("a.example", 1, 0, "heading", 2, "Chapter 1"), ("a.example", 1, 1, "dialogue", 3, '"Go," he  said.'), ("a.example", 1, 2, "dialogue", 2, "- no"), ("a.example", 1, 3, "narration", 3, "Long and wide"), ("b.example", 1, 0, "narration", 1, "A.")]
    assert sorted(tuple(r) for r in found.collect()) == [(*t[:-1], hashlib.md5(t[-1].encode()).hexdigest()) for t in texts]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "raw_blocks" in line for line in plan.splitlines())
    assert sum(line.count("transform(raw_blocks") for line in plan.splitlines()) <= 1
