"""Entity mentions as spans: validation, selection by label policy, conflicts, deduplication.

A mention has source, idx (paragraph), start, end, label, model, score, valid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

SPAN = ["source", "idx", "start", "end"]
# Fixed values of the selection policy: chosen model and least score by label, and the supplement's.
POLICY = {"PER": ("span", 0.5), "DATE": ("span", 0.5), "LOC": ("token", 0.0), "ORG": ("token", 0.0), "MISC": ("token", 0.0)}
SUPPLEMENT, SUPPLEMENT_SCORE, EVENT_HIGH, CONFLICT_FLOOR = "token", 0.9, 0.9, 0.5
CANDIDATE_LABELS = ("TIME", "EVENT")


def validate(mentions: DataFrame, text: Column) -> DataFrame:
    """valid: the offsets lie in the text and hold the mention's word."""
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length(text)) & (F.substring(text, F.col("start") + 1, F.col("end") - F.col("start")) == F.col("word"))
    return mentions.withColumn("valid", F.coalesce(ok, F.lit(False)))


def deduplicate(mentions: DataFrame) -> DataFrame:
    """One row per span, label and model: the best score, and all references."""
    return mentions.groupBy(*SPAN, "label", "model").agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("ref"))))), ",").alias("refs"))


def primary(mentions: DataFrame) -> DataFrame:
    keep = F.lit(False)
    for label, (model, least) in POLICY.items():
        keep = keep | ((F.col("label") == label) & (F.col("model") == model) & (F.col("score") >= least))
    return mentions.filter("valid").filter(keep)


def without_overlap(mentions: DataFrame, others: DataFrame) -> DataFrame:
    """Mentions that no other overlaps in their paragraph: an interval anti-join on the paragraph key."""
    o = others.select(F.col("source").alias("os"), F.col("idx").alias("oi"), F.col("start").alias("ostart"), F.col("end").alias("oend"))
    on = (F.col("source") == F.col("os")) & (F.col("idx") == F.col("oi")) & (F.col("start") < F.col("oend")) & (F.col("ostart") < F.col("end"))
    return mentions.join(o, on, "left_anti")


def greedy(mentions: DataFrame) -> DataFrame:
    """Per paragraph, best score first, mentions that overlap none taken before. Sequential within a
    paragraph, whose mentions are bounded by its text."""

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        kept: list[int] = []
        taken: list[tuple[int, int]] = []
        for i, r in pdf.sort_values(["score", "start", "end"], ascending=[False, True, True]).iterrows():
            if all(r.end <= s or e <= r.start for s, e in taken):
                kept.append(i)
                taken.append((r.start, r.end))
        return pdf.loc[kept]

    return mentions.groupBy("source", "idx").applyInPandas(take, mentions.schema)


def select(mentions: DataFrame) -> DataFrame:
    """Primary mentions by policy and the supplement: persons of the other model with a high score that
    overlap no chosen person, greedily; each with the models that support its span and label."""
    chosen = primary(mentions)
    persons = chosen.filter("label = 'PER'")
    extra = mentions.filter(F.col("valid") & (F.col("label") == "PER") & (F.col("model") == SUPPLEMENT) & (F.col("score") >= SUPPLEMENT_SCORE))
    added = greedy(without_overlap(extra, persons))
    both = chosen.withColumn("reason", F.lit("primary")).unionByName(added.withColumn("reason", F.lit("supplement")))
    one = both.withColumn("rn", F.row_number().over(W.partitionBy(*SPAN, "label").orderBy("reason", F.desc("score")))).filter("rn = 1").drop("rn")
    support = mentions.filter("valid").groupBy(*SPAN, "label").agg(F.array_join(F.array_sort(F.collect_set("model")), ",").alias("models"))
    return one.join(support, [*SPAN, "label"])


def candidates(mentions: DataFrame, model: str = "span") -> DataFrame:
    """Time and event mentions: never facts, at most candidates."""
    rows = mentions.filter(F.col("valid") & (F.col("model") == model) & F.col("label").isin(*CANDIDATE_LABELS)).dropDuplicates([*SPAN, "label"])
    high = (F.col("label") == "EVENT") & (F.col("score") >= EVENT_HIGH)
    return rows.withColumn("status", F.when(high, "candidate_high_priority").otherwise("candidate"))


def conflicts(mentions: DataFrame, chosen: DataFrame) -> DataFrame:
    """Spans with more than one label: unresolved where chosen mentions disagree, else resolved by the
    policy, or without a chosen mention. Weak alternatives count only above a floor or if chosen."""
    picked = chosen.select(*SPAN, "label", "model", F.lit(True).alias("is_chosen"))
    rows = mentions.filter("valid").filter(~F.col("label").isin(*CANDIDATE_LABELS)).join(picked, [*SPAN, "label", "model"], "left")
    rows = rows.filter((F.col("score") >= CONFLICT_FLOOR) | F.col("is_chosen"))
    n_chosen = F.countDistinct(F.when(F.col("is_chosen"), F.col("label")))
    agg = rows.groupBy(*SPAN).agg(F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"), F.countDistinct("label").alias("n"), n_chosen.alias("c"))
    status = F.when(F.col("c") > 1, "unresolved").when(F.col("c") == 1, "resolved_by_primary").otherwise("no_selected_candidate")
    return agg.filter("n > 1").select(*SPAN, "labels", status.alias("status"))


def quarantine(chosen: DataFrame, conflict_rows: DataFrame) -> DataFrame:
    return chosen.join(conflict_rows.filter("status = 'unresolved'").select(*SPAN), SPAN, "left_anti")


def windows(texts: DataFrame, size: int = 384, overlap: int = 64) -> DataFrame:
    """(id, window, first, last): word windows that cover a text with an overlap."""
    n = F.size(F.regexp_extract_all("text", F.lit("([^ \\t\\n\\r]+)"), 1))
    step = size - overlap
    count = F.greatest(F.ceil((n - overlap) / step), F.lit(1)).cast("int")
    rows = texts.select("id", n.alias("n"), F.posexplode(F.sequence(F.lit(0), count - 1)).alias("window", "_i")).filter("n > 0")
    return rows.select("id", "window", (F.col("window") * step).alias("first"), F.least(F.col("window") * step + size, "n").alias("last"))


def fit_windows(texts: DataFrame, count_tokens, size: int = 384, most: int = 480, overlap: int = 64) -> DataFrame:
    """As windows(), each shrunk by an eighth until ``count_tokens(words)`` fits: sequential per text,
    in batches of texts (id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for id_, text in zip(pdf["id"], pdf["text"], strict=True):
                words, at, w = (text or "").split(), 0, 0
                while at < len(words):
                    n = min(size, len(words) - at)
                    while n > 1 and count_tokens(words[at : at + n]) > most:
                        n = max(1, n - max(1, n // 8))
                    out.append((id_, w, at, at + n))
                    if at + n >= len(words):
                        break
                    at, w = at + max(1, n - overlap), w + 1
            yield pd.DataFrame(out, columns=["id", "window", "first", "last"])

    return texts.select("id", "text").mapInPandas(run, f"id {texts.schema['id'].dataType.simpleString()}, window int, first int, last int")


def overlap_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """Intersection over union of overlapping spans of two models."""
    r = b.select("source", "idx", F.col("start").alias("start_b"), F.col("end").alias("end_b"), F.col("label").alias("label_b"))
    inter = F.least("end", "end_b") - F.greatest("start", "start_b")
    return a.join(r, ["source", "idx"]).filter(inter > 0).withColumn("iou", inter / (F.greatest("end", "end_b") - F.least("start", "start_b")))


@F.pandas_udf(StringType())
def mask_same_length(texts: pd.Series) -> pd.Series:
    """Replace references and tags by blanks of the same length, so that offsets stay."""
    return texts.str.replace(r"<[^>]*>|\[\d+\]", lambda m: " " * len(m.group()), regex=True)
