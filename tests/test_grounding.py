"""Evidence of answers, spans and sections of text, discovery in layers, against stated cases."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as X
from tessera.operators import closure, grounding


def test_nicknames(spark):
    texts = [
        ("a", "USS Enterprise", "A carrier. She was nicknamed the Big E by her crew. Sunk never."),
        ("b", "Cactus", "The codename was \"Cactus\" then."),  # the name itself is no nickname
        ("c", "Base", "Known as a base, nothing more."),
        ("d", "Henderson", "It was also known as “Lucky field” to some"),
        ("e", None, None),
    ]
    rows = grounding.nicknames(spark.createDataFrame(texts, "id string, name string, text string")).collect()
    assert {(r.id, r.label, r.evidence) for r in rows} == {
        ("a", "Big E", "She was nicknamed the Big E by her crew."),
        ("d", "Lucky field", "It was also known as “Lucky field” to some"),
    }


def test_ungrounded_names(spark):
    answers = spark.createDataFrame([(1, "Iwo Jima and Guam."), (2, "The Allied force on Guam"), (3, None)], "run_id long, answer string")
    names = spark.createDataFrame([("iwo jima", "p1"), ("guam", "p2"), ("guam", "p3"), ("allied", "x")], "name string, id string")
    grounded = spark.createDataFrame([(1, "p3")], "run_id long, id string")
    shown = spark.createDataFrame([(9, "Guam")], "run_id long, text string")
    rows = grounding.ungrounded_names(answers, names, grounded, shown, ["allied"]).collect()
    assert {(r.run_id, r.name) for r in rows} == {(1, "iwo jima"), (2, "guam")}


def test_text_battles_need_one_event(spark):
    events = spark.createDataFrame([("e1", "Battle of Bataan", 1942, 1942), ("e2", "battle of Bataan", 1945, 1945), ("e3", "Undated", None, None)], "id string, name string, low int, high int")
    items = spark.createDataFrame([(1, "Battle of Bataan", None, None), (2, "Battle of Bataan", 1944, 1945), (3, "Undated", 1900, 1900)], "item long, name string, low int, high int")
    assert {(r.item, r.id) for r in grounding.text_battles(items, events).collect()} == {(2, "e2"), (3, "e3")}


def test_source_references_once_and_in_order(spark):
    columns = "run_id long, source string, target string, ord int, provider string, record_id string, page string"
    evidence = spark.createDataFrame([(1, "c", "z", 0, "W", "r1", None), (1, "a", "z", 1, "W", "r2", None), (1, "a", "c", 2, "W", "r1", None), (1, "z", "z", 3, "W", "r9", None)], columns)
    answer, context = (spark.createDataFrame([(1, i)], "run_id long, id string") for i in ("a", "c"))
    own = spark.createDataFrame([("a", 0, "E", "x", None), ("z", 0, "E", "y", None)], "id string, ord int, provider string, record_id string, page string")
    rows = grounding.source_references(evidence, answer, context, own).orderBy("rank").collect()
    assert [(r.rank, r.record_id) for r in rows] == [(1, "r2"), (2, "r1"), (3, "x")]


def test_layers_log_what_a_limit_leaves(spark):
    steps = spark.createDataFrame([("s", "a"), ("s", "b"), ("s", "c"), ("t", "c"), ("c", "s"), ("c", "d")], "`from` string, `to` string")
    found, log = closure.layers(steps, spark.createDataFrame([("s",), ("t",)], "id string"), 5, most=2)
    assert {(r.id, r.layer) for r in found.collect()} == {("s", 0), ("t", 0), ("c", 1), ("a", 1), ("d", 2)}
    assert {tuple(r) for r in log.select("layer", "candidates", "kept", "left").collect()} == {(1, 3, 2, 1), (2, 1, 1, 0), (3, 0, 0, 0)}


def test_raw_spans_equal_a_search(spark):
    text = "  A\t\tbig \n ship  \U0001f6a2sails  "
    flat = re.sub(r"\s+", " ", text)
    spans = [(text, i, j) for i in range(len(flat)) for j in range(i + 1, len(flat) + 1)] + [(text, 3, 3), (text, -1, 2), (text, 0, 999), (None, 0, 1)]
    frame = spark.createDataFrame(spans, "text string, s int, e int").select("s", "e", "text", X.collapse(F.col("text")).alias("flat"), X.raw_span("text", "s", "e").alias("raw"))
    for r in frame.collect():
        if r.text is None or not 0 <= r.s < r.e <= len(flat):
            assert r.raw["start"] is None and r.raw["end"] is None
        else:
            assert r.flat == flat
            assert re.sub(r"\s+", " ", text[r.raw["start"]:r.raw["end"]]) == flat[r.s:r.e]


def test_sections_go_with_what_is_below_them(spark):
    cases = {
        "a\n== Namesake ==\nx\n=== More ===\ny\n== History ==\nz": "a\n== History ==\nz",
        "a\n=== Naming ===\nx\n== History ==\nz\n==name==\nq": "a\n== History ==\nz\n",
        "a\n== Names of ships ==\nx": "a\n== Names of ships ==\nx",
        "a = b": "a = b",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.without_sections(F.col("t")).alias("u")).collect()
    assert {r.t: r.u for r in rows} == cases


def test_short_dates_and_urls(spark):
    dates = {"1942-08-07": "7 Aug 1942", "1943-01": "Jan 1943", "1944": "1944", "1944-13": "1944-13", "soon": "soon"}
    rows = spark.createDataFrame([(k,) for k in dates], "d string").select("d", D.short(F.col("d")).alias("s")).collect()
    assert {r.d: r.s for r in rows} == dates
    span = spark.range(1).select(D.span_text(F.lit("1942-08-07"), F.lit("1945-06")).alias("a"), D.span_text(F.lit("1942"), F.lit("1942")).alias("b"), D.span_text(F.lit(None).cast("string"), F.lit("1942")).alias("c"))
    assert tuple(span.first()) == ("Aug 1942–Jun 1945", "1942", "no dates")
    refs = [("Wikidata", "Q362$ab", None, "https://www.wikidata.org/wiki/Q362"), ("Wikidata", "P1", None, None), ("Wikipedia", None, "USS A&B/C", "https://en.wikipedia.org/wiki/USS_A%26B/C"), ("EventKG", "Q1", "x", None)]
    rows = spark.createDataFrame([r[:3] for r in refs], "provider string, record string, page string")
    assert [r.u for r in rows.select(X.source_url(F.col("provider"), F.col("record"), F.col("page")).alias("u")).collect()] == [r[3] for r in refs]
