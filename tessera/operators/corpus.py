"""Corpus classification: tags by rule tables, scope of battles, ties to anchors, verdicts, templates.

A page has title, qid, infobox (name), infobox_text, infobox_years, categories, links. Claims are long:
(qid, prop, value).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

# --- templates ------------------------------------------------------------------------------------

TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\|")


def template_fields(text: str, name: str) -> dict[str, str]:
    """Fields of the first template whose name begins with ``name``, cut at its own bars only: bars inside
    nested templates and links belong to the values. An unclosed template ends with the text."""
    opened = re.search(r"\{\{\s*" + re.escape(name), text, re.IGNORECASE)
    if not opened:
        return {}
    depth, cuts, end = 0, [], len(text)
    for m in TOKEN.finditer(text, opened.start()):
        token = m.group()
        if token in ("{{", "[["):
            depth += 1
        elif token in ("}}", "]]"):
            depth -= 1
            if depth == 0:
                end = m.start()
                break
        elif depth == 1:
            cuts.append(m.start())
    out: dict[str, str] = {}
    for a, b in zip(cuts, [*cuts[1:], end], strict=True):
        key, equals, value = text[a + 1 : b].partition("=")
        if equals:
            out.setdefault(key.strip().lower(), value.strip())
    return out


def infobox(text: Column, name: str = "infobox") -> Column:
    """template_fields() of a column, in batches."""

    @F.pandas_udf(MapType(StringType(), StringType()))
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: template_fields(t or "", name))

    return parse(text)


def plain_text(text: str) -> str:
    """Prose of a wikitext: nested templates and tables go innermost first, links keep their label."""
    out = re.sub(r"(?s)<!--.*?-->|<ref[^>/]*/>|<ref[^>]*>.*?</ref>", "", text)
    before = None
    while before != out:
        before, out = out, re.sub(r"\{\{[^{}]*\}\}|(?s:\{\|(?:(?!\{\|).)*?\|\})", "", out)
    out = re.sub(r"\[\[(?:File|Image|Category):[^\[\]]*(?:\[\[[^\]]*\]\][^\[\]]*)*\]\]", "", out, flags=re.IGNORECASE)
    out = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", out)
    out = re.sub(r"'{2,}|<[^>]*>|^=+.*=+\s*$", "", out, flags=re.MULTILINE)
    return "\n".join(line.strip() for line in out.split("\n") if line.strip())


@F.pandas_udf(StringType())
def plain_text_udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda t: plain_text(t or ""))


def title_form(title: Column) -> Column:
    """Spaces for underscores, no section, first letter upper."""
    bare = F.trim(F.substring_index(F.translate(title, "_", " "), "#", 1))
    return F.concat(F.upper(F.substring(bare, 1, 1)), F.substring(bare, 2, 1 << 20))


def article_links(wikitext: Column) -> Column:
    """Targets of links to articles, in title form, once each."""
    raw = F.regexp_extract_all(wikitext, F.lit(r"\[\[([^\[\]|]+)"), 1)
    kept = F.filter(raw, lambda l: ~l.rlike(r"(?i)^:?(file|image|category|template|help|wikt|[a-z]{2}):"))
    return F.array_sort(F.array_distinct(F.transform(kept, title_form)))


# --- rules ----------------------------------------------------------------------------------------


def tags(pages: DataFrame, rules: DataFrame, class_tags: DataFrame) -> DataFrame:
    """(title, tag, source): the first tag by source (infobox, wikidata, category), then by the rules'
    order. ``rules`` is a constant table (source, pattern, tag, rank); ``class_tags`` has (title, tag, rank)."""
    texts = pages.select("title", F.lit("infobox").alias("source"), F.col("infobox").alias("value")).unionByName(pages.select("title", F.lit("category").alias("source"), F.explode("categories").alias("value")))
    by_rule = texts.join(F.broadcast(rules.withColumnRenamed("source", "_s")), F.expr("source = _s and value rlike pattern")).select("title", "source", "tag", "rank")
    found = by_rule.unionByName(class_tags.select("title", F.lit("wikidata").alias("source"), "tag", "rank"))
    order = F.when(F.col("source") == "infobox", 0).when(F.col("source") == "wikidata", 1).otherwise(2)
    # A media tag counts only from an infobox or where there is no other.
    media = (F.col("tag") == "Media") & (F.col("source") != "infobox")
    return found.groupBy("title").agg(F.min_by(F.struct("tag", "source"), F.struct(media, order, "rank")).alias("t")).select("title", "t.tag", "t.source")


def refine(tag: Column, title: Column, battle_tags: tuple[str, ...] = ("Battle", "Operation", "Campaign")) -> Column:
    battle = tag.isin(*battle_tags)
    ship_class = title.rlike(r"-class\b| class\b")
    return F.when(battle & title.rlike(r"(?i)\bcampaign\b"), "Campaign").when(battle & title.startswith("Operation "), "Operation").when(tag.isin("Ship", "Ship class"), F.when(ship_class, "Ship class").otherwise("Ship")).otherwise(tag)


def battle_scope(years: Column, war: tuple[int, int], signals: dict[str, Column]) -> tuple[Column, Column]:
    """(verdict, reason): dated outside the war; else in, by the signals that hold; else no participants."""
    off = (F.size(years) > 0) & ~F.exists(years, lambda y: y.between(*war))
    held = F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in signals.items()]))
    verdict = F.when(off, "dated").when(F.size(held) > 0, "in").otherwise("no participants")
    return verdict, F.array_join(held, ", ")


def battle_grade(sides: Column, claims_agree: Column) -> Column:
    return F.when(sides == "opposed", "in").when(sides == "support", "peripheral").when(sides == "not opposed", F.when(claims_agree, "disagree").otherwise("out")).otherwise("in")


#: Claims that tie a page to a battle, and those that tie pages of a tag only weakly.
ANCHOR_PROPERTIES = ("P607", "P1344", "P793")
WEAK_CLAIMS = {"P793": "Person"}


def anchor_ties(pages: DataFrame, claims: DataFrame, battles: DataFrame, aliases: DataFrame, least_links: int = 2) -> DataFrame:
    """(title, verdict, grade, ties) of pages (title, qid, tag, categories, links) by their ties to battles
    (battle, qid, umbrella): claims (qid, prop, value) of the anchor properties and categories are strong,
    links (through aliases: alias, battle) weak, and so are claims of a property that a page's tag makes
    weak. An umbrella is never the only tie. Three equi-joins; a tie counts once per battle."""
    tied = claims.filter(F.col("prop").isin(*ANCHOR_PROPERTIES))
    weak = F.lit(False)
    for prop, tag in WEAK_CLAIMS.items():
        weak = weak | ((F.col("prop") == prop) & F.coalesce(F.col("tag") == tag, F.lit(False)))
    named = battles.select(F.col("qid").alias("value"), "battle")
    by_claim = pages.select("title", "qid", "tag").join(tied, "qid").join(named, "value").select("title", "battle", (~weak).alias("strong"))
    by_category = pages.select("title", F.explode("categories").alias("battle")).join(battles.select("battle"), "battle").select("title", "battle", F.lit(True).alias("strong"))
    by_link = pages.select("title", F.explode("links").alias("alias")).join(aliases, "alias").filter("battle <> title").select("title", "battle", F.lit(False).alias("strong"))
    ties = by_claim.unionByName(by_category).unionByName(by_link).groupBy("title", "battle").agg(F.max("strong").alias("strong"))
    rows = ties.join(battles.select("battle", "umbrella"), "battle")
    agg = rows.groupBy("title").agg(F.count_if(F.col("strong") & ~F.col("umbrella")).alias("s"), F.count_if(~F.col("umbrella")).alias("specific"), F.count(F.lit(1)).alias("n"))
    out = pages.select("title").join(agg, "title", "left").fillna(0, ["s", "specific", "n"])
    grade = F.when(F.col("s") > 0, "strong").when((F.col("n") >= least_links) & (F.col("specific") > 0), "links").when(F.col("n") == 0, "none").when(F.col("specific") == 0, "umbrella only").otherwise("one battle")
    verdict = F.when(grade.isin("strong", "links"), "anchored").when(grade == "none", "none").otherwise("gray")
    return out.select("title", verdict.alias("verdict"), grade.alias("grade"), F.col("n").alias("ties"))


def classify(rows: DataFrame) -> DataFrame:
    """verdict of (tag, is_battle, scope, battle_grade, participants_known, broad, anchor, allied_only)."""
    anchored = F.when(F.col("anchor") == "anchored", F.when(F.col("tag").isNotNull(), "in").otherwise("gray")).when(F.col("anchor") == "gray", "gray").otherwise("out")
    battle = F.when(F.col("scope") == "in", F.when(F.col("battle_grade").isin("in", "peripheral"), "in").when(F.col("battle_grade") == "disagree", "gray").otherwise("out")).when(F.col("scope") == "dated", "out").when(F.col("participants_known"), "out").otherwise(F.when(F.col("anchor") == "anchored", "in").when(F.col("anchor") == "gray", "gray").otherwise("out"))
    verdict = F.when(F.coalesce(F.col("tag") == "Media", F.lit(False)), "out").when(F.col("is_battle"), battle).when(F.col("broad"), "out").when((anchored != "out") & F.col("allied_only"), "out").otherwise(anchored)
    return rows.withColumn("verdict", verdict)


def blocked(category: Column, names: list[str], pattern: str) -> Column:
    return category.isin(names) | category.rlike(pattern)


def crawl_round(frontier: DataFrame, known: DataFrame, edges: DataFrame) -> DataFrame:
    """One round of a depth-bounded crawl: pages (title, depth left) reached from the frontier with more
    depth left than known before."""
    reached = frontier.filter("depth > 0").join(edges, frontier["title"] == edges["source"]).select(F.col("target").alias("title"), (F.col("depth") - 1).alias("depth"))
    best = reached.groupBy("title").agg(F.max("depth").alias("depth"))
    seen = known.select("title", F.col("depth").alias("_had"))
    return best.join(seen, "title", "left").filter("_had is null or depth > _had").select("title", "depth")
