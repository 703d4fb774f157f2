"""Queries about what answers rest on: nicknames, evidence, references, discovery, spans of text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.functions import text as X
from tessera.operators import closure, grounding
from tessera.plans.bridge import EVENT, PLACE, Star
from tessera.plans.graph_queries import HAVERSINE
from tessera.plans.registry import query


def key(prefix: str, number: Column | str) -> Column:
    return F.concat(F.lit(prefix), number)


TELLING = """t AS (SELECT 'S' || s_suppkey AS id, s_name AS name, CASE s_suppkey % 3 WHEN 0 THEN 'Founded early. It was nicknamed the Big ' || n_name || ' by all. More follows.'
    WHEN 1 THEN 'Known to few. Also known as "number ' || s_suppkey || '" in print' ELSE 'Nothing is said of it.' END AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


@query(
    "nicknames",
    f"""WITH {TELLING} SELECT id, CASE WHEN text LIKE 'F%' THEN regexp_extract(text, 'the (Big [A-Z_0-9]+)', 1) ELSE regexp_extract(text, '"([^"]+)"', 1) END AS label,
    CASE WHEN text LIKE 'F%' THEN regexp_extract(text, '(It was [^.]*[.])', 1) ELSE regexp_extract(text, '(Also .*)$', 1) END AS evidence FROM t WHERE text NOT LIKE 'N%'""",
)
def nicknames(star: Star) -> DataFrame:
    n = F.col("s_suppkey") % 3
    first = F.concat(F.lit("Founded early. It was nicknamed the Big "), "n_name", F.lit(" by all. More follows."))
    second = F.concat(F.lit('Known to few. Also known as "number '), "s_suppkey", F.lit('" in print'))
    rows = star.table("supplier").join(star.table("nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    told = rows.select(key("S", "s_suppkey").alias("id"), F.col("s_name").alias("name"), F.when(n == 0, first).when(n == 1, second).otherwise("Nothing is said of it.").alias("text"))
    return grounding.nicknames(told).select("id", "label", "evidence")


@query("quoted_aliases", "SELECT 'P' || p_partkey AS id, p_brand AS label FROM part WHERE p_size % 2 = 0")
def quoted_aliases(star: Star) -> DataFrame:
    mark = F.when(F.col("p_size") % 2 == 0, F.lit('"')).otherwise("")
    labels = star.table("part").select(key("P", "p_partkey").alias("id"), F.concat("p_name", F.lit(" "), mark, "p_brand", mark).alias("label"))
    return grounding.quoted_aliases(labels).select("id", "label")


@query(
    "ungrounded_names",
    """WITH a AS (SELECT o_orderkey AS run_id, n_name, n_nationkey FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey)
    SELECT run_id, replace(lower(n_name), '_', ' ') AS name FROM a WHERE n_nationkey <> run_id % 5 AND run_id % 11 <> 0 AND n_nationkey <> 7""",
)
def ungrounded_names(star: Star) -> DataFrame:
    """Answers name their customer's nation; the evidence holds one of five nations, every eleventh run's
    tool text the answer's own, and one name is of common words alone."""
    rows = star.table("orders").join(star.table("customer"), F.col("c_custkey") == F.col("o_custkey")).join(star.table("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    answers = rows.select(F.col("o_orderkey").alias("run_id"), F.concat(F.lit("It was in "), "n_name", F.lit(", they say.")).alias("answer"))
    names = star.table("nation").select(F.array_join(X.ascii_tokens(F.col("n_name")), " ").alias("name"), key("N", "n_nationkey").alias("id"))
    grounded = star.table("orders").select(F.col("o_orderkey").alias("run_id"), key("N", (F.col("o_orderkey") % 5).cast("string")).alias("id"))
    shown = answers.filter("run_id % 11 = 0").select("run_id", F.col("answer").alias("text"))
    return grounding.ungrounded_names(answers, names, grounded, shown, ["nation", "7"])


@query(
    "source_references",
    """WITH e AS (SELECT l_orderkey AS run_id, l_suppkey AS a, l_partkey AS b, l_linenumber AS ord, l_linestatus AS provider, l_returnflag AS record_id, 'p' || l_partkey % 4 AS page FROM lineitem),
    r AS (SELECT run_id, provider, record_id, page, CASE WHEN a % 2 = 0 THEN 1 ELSE 2 END AS part, ord FROM e WHERE a % 2 = 0 OR b % 3 = 0
    UNION ALL SELECT DISTINCT run_id, 'own', 'S' || a, NULL, 3, 0 FROM e WHERE a % 2 = 0),
    f AS (SELECT run_id, provider, record_id, page, min((part, ord)) AS first FROM r GROUP BY ALL)
    SELECT * FROM (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY first, provider, record_id, page)::INT AS rank, provider, record_id, page FROM f) WHERE rank <= 5""",
)
def source_references(star: Star) -> DataFrame:
    """Shipments are evidence; even suppliers are a run's answer, every third part its context."""
    l = star.table("lineitem")
    run = F.col("l_orderkey").alias("run_id")
    ref = [F.col("l_linestatus").alias("provider"), F.col("l_returnflag").alias("record_id"), key("p", (F.col("l_partkey") % 4).cast("string")).alias("page")]
    evidence = l.select(run, key("S", "l_suppkey").alias("source"), key("P", "l_partkey").alias("target"), F.col("l_linenumber").cast("int").alias("ord"), *ref)
    answer = l.filter("l_suppkey % 2 = 0").select(run, key("S", "l_suppkey").alias("id"))
    context = l.filter("l_partkey % 3 = 0").select(run, key("P", "l_partkey").alias("id"))
    own = star.table("supplier").select(key("S", "s_suppkey").alias("id"), F.lit(0).alias("ord"), F.lit("own").alias("provider"), key("S", "s_suppkey").alias("record_id"), F.lit(None).cast("string").alias("page"))
    return grounding.source_references(evidence, answer, context, own, most=5)


@query("expanded_sets", "SELECT DISTINCT l_orderkey AS run_id, 'set' || l_suppkey AS handle, CASE WHEN l_suppkey % 3 = 0 THEN 'unknown' WHEN l_orderkey % 2 = 0 THEN 'not_in_tool_output' END AS reason FROM lineitem")
def expanded_sets(star: Star) -> DataFrame:
    rows = star.table("lineitem").select(F.col("l_orderkey").alias("run_id"), key("set", "l_suppkey").alias("handle"))
    registry = star.table("supplier").filter("s_suppkey % 3 <> 0").select(key("set", "s_suppkey").alias("handle"))
    return grounding.expanded_sets(rows, registry, rows.filter("run_id % 2 = 1"))


@query(
    "text_battles",
    f"""WITH {EVENT}, e AS (SELECT id, 'Action ' || o_orderkey % 12000 AS name, year(lo) AS low FROM event),
    i AS (SELECT p_partkey AS item, 'ACTION ' || p_partkey AS name, 1992 + p_size % 3 AS low FROM part)
    SELECT item, min(id) AS id FROM i JOIN e ON lower(i.name) = lower(e.name) AND e.low BETWEEN i.low AND i.low + 1 GROUP BY item HAVING count(*) = 1""",
)
def text_battles(star: Star) -> DataFrame:
    year = F.year("lo")
    events = star.events().select("id", F.concat(F.lit("Action "), (F.substring("id", 2, 20).cast("long") % 12000).cast("string")).alias("name"), year.alias("low"), year.alias("high"))
    low = (F.lit(1992) + F.col("p_size") % 3).cast("int")
    items = star.table("part").select(F.col("p_partkey").alias("item"), F.concat(F.lit("ACTION "), "p_partkey").alias("name"), low.alias("low"), (low + 1).alias("high"))
    return grounding.text_battles(items, events)


@query(
    "event_region",
    f"""WITH {PLACE}, ev AS (SELECT 'O' || o_orderkey AS id, 'N' || o_orderkey % 25 AS place FROM orders),
    near AS (SELECT id FROM place, (SELECT 10.0 AS lat, 20.0 AS lon) q WHERE {HAVERSINE.format(a='q.', b='place.')} <= 5000)
    SELECT ev.id, CASE WHEN place IN ('N1', 'N2', 'N3') THEN 'place' ELSE 'distance' END AS how FROM ev WHERE place IN ('N1', 'N2', 'N3') OR place IN (SELECT id FROM near)""",
)
def event_region(star: Star) -> DataFrame:
    at = star.table("orders").select(key("O", "o_orderkey").alias("id"), key("N", (F.col("o_orderkey") % 25).cast("string")).alias("place"))
    inside = star.places().filter(F.col("id").isin("N1", "N2", "N3")).select(F.col("id").alias("place"))
    return grounding.event_region(at, inside, star.places().select("id", "lat", "lon"), 10.0, 20.0, 5000.0)


@query("discovery_recall", "SELECT count(*) AS relevant, count(*) FILTER (doc_id % 3 <> 0) AS discovered, count(*) FILTER (doc_id % 3 <> 0 AND doc_id % 2 = 0) AS included FROM labels WHERE quality = 1")
def discovery_recall(star: Star) -> DataFrame:
    sample = star.table("labels").filter("quality = 1").select(F.col("doc_id").alias("item"))
    found = star.table("documents").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("item"), (F.col("doc_id") % 2 == 0).alias("in_scope"))
    return grounding.discovery_recall(sample, found)


@query(
    "layered_discovery",
    """WITH RECURSIVE s AS (SELECT 'N' || s_nationkey AS f, 'S' || s_suppkey AS t FROM supplier UNION SELECT 'S' || l_suppkey, 'P' || l_partkey FROM lineitem UNION SELECT 'P' || l_partkey, 'S' || l_suppkey FROM lineitem),
    w AS (SELECT 'N0' AS id, 0 AS layer UNION SELECT s.t, layer + 1 FROM w JOIN s ON s.f = w.id WHERE layer < 3)
    SELECT id, min(layer) AS layer FROM w GROUP BY id""",
)
def layered_discovery(star: Star) -> DataFrame:
    """From one nation to its suppliers, their parts and all suppliers of these."""
    l = star.table("lineitem")
    s, p = key("S", "l_suppkey"), key("P", "l_partkey")
    steps = star.table("supplier").select(key("N", "s_nationkey").alias("from"), key("S", "s_suppkey").alias("to"))
    steps = steps.union(l.select(s, p)).union(l.select(p, s)).distinct()
    seeds = star.places().filter("id = 'N0'").select("id")
    return closure.layers(steps, seeds, 3)[0]


@query("raw_spans", r"SELECT doc_id AS id, length(regexp_replace(text, '\s+$', '')) - length(regexp_extract(text, '(\S+)\s*$', 1)) AS start, length(regexp_replace(text, '\s+$', '')) AS \"end\" FROM documents WHERE regexp_matches(text, '\S')".replace("\\\"", '"'))
def raw_spans(star: Star) -> DataFrame:
    """Where the last word of a text's collapsed form stands in the text itself."""
    flat = X.collapse(F.col("text"))
    rows = star.table("documents").filter(F.col("text").rlike(r"\S")).select("doc_id", "text", F.rtrim(flat).alias("flat"))
    end = F.length("flat")
    span = X.raw_span("text", (end - F.length(F.substring_index("flat", " ", -1))).cast("int"), end.cast("int"))
    return rows.select(F.col("doc_id").alias("id"), span.alias("s")).select("id", F.col("s.start").cast("long").alias("start"), F.col("s.end").cast("long").alias("end"))


@query("without_sections", "SELECT p_partkey AS id, 'Intro.' || chr(10) || CASE WHEN p_size % 2 = 0 THEN '== History ==' || chr(10) || p_name ELSE '' END AS text FROM part")
def without_sections(star: Star) -> DataFrame:
    """A namesake section with one below it goes, up to the next section of its level or to the end."""
    section = F.concat(F.lit("== Namesake ==\nOf "), "p_brand", F.lit(".\n=== Her life ===\nLong.\n"))
    after = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("== History ==\n"), "p_name")).otherwise("")
    return star.table("part").select(F.col("p_partkey").alias("id"), X.without_sections(F.concat(F.lit("Intro.\n"), section, after)).alias("text"))


@query("span_texts", f"WITH {EVENT} SELECT id, strftime(lo, '%-d %b %Y') AS day, strftime(lo, '%b %Y') || CASE WHEN strftime(lo, '%b %Y') = strftime(hi, '%b %Y') THEN '' ELSE '–' || strftime(hi, '%b %Y') END AS span FROM event")
def span_texts(star: Star) -> DataFrame:
    return star.events().select("id", D.short(F.col("start_date")).alias("day"), D.span_text(F.col("start_date"), F.col("end_date")).alias("span"))


@query(
    "source_urls",
    """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'https://www.wikidata.org/wiki/Q' || o_custkey WHEN o_orderkey % 3 = 1 THEN 'https://en.wikipedia.org/wiki/Order_' || o_orderkey || '/' || 'a%26b' END AS url FROM orders""",
)
def source_urls(star: Star) -> DataFrame:
    n = F.col("o_orderkey") % 3
    provider = F.when(n == 0, "Wikidata").when(n == 1, "Wikipedia").otherwise("EventKG")
    record = F.when(n == 0, F.concat(F.lit("Q"), "o_custkey", F.lit("$1-2")))
    page = F.concat(F.lit("Order "), "o_orderkey", F.lit("/a&b"))
    return star.table("orders").select(F.col("o_orderkey").alias("id"), X.source_url(provider, record, page).alias("url"))
