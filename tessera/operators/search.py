"""Names and full text: exact and fuzzy search, gazetteer matching, BM25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.fuzzy import weighted_ratio_udf

# Scores of a clear match, a part of an alias and a match but for the article; margin of
# a tie; least score; labels examined.
CLEAR, ALIAS_PART, ARTICLE, MARGIN, CUTOFF, CANDIDATES = 90, 97, 94, 5, 60, 200


def exact(labels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, id, label, score): labels (id, label, kind) equal to a query but for case, marks and a
    leading article. An equi-join on the comparison form."""
    form = lambda c: X.strip_article(X.normalize_latin(c))
    l = labels.withColumn("_n", X.normalize_latin(F.col("label"))).withColumn("_k", form(F.col("label")))
    q = queries.withColumn("_q", X.normalize_latin(F.col("query"))).withColumn("_k", form(F.col("query")))
    return l.join(q, "_k").select("query", "id", "label", "kind", F.when(F.col("_n") == F.col("_q"), 100).otherwise(ARTICLE).alias("score"))


def fuzzy(labels: DataFrame, query: str, most: int = 3, prefix: int = 1) -> DataFrame:
    """Labels within an edit distance of one query; the first letters must agree. A label may not
    change a number that the query has."""
    n, q = X.normalize_latin(F.col("label")), X.normalize_latin(F.lit(query))
    digits = lambda c: F.filter(X.ascii_tokens(c), lambda t: t.rlike("^[0-9]"))
    rows = labels.withColumn("_n", n).filter(F.substring("_n", 1, prefix) == F.substring(q, 1, prefix))
    rows = rows.withColumn("distance", F.levenshtein("_n", q)).filter(F.col("distance") <= most)
    clash = (F.size(digits(F.col("_n"))) > 0) & (F.size(digits(q)) > 0) & ~F.arrays_overlap(digits(F.col("_n")), digits(q))
    return rows.filter(~clash).drop("_n")


def search(labels: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Ranked search by weighted ratio: best label per node; ambiguous where another result is within
    the margin (a fuzzy one does not tie with an exact one); clear for a lone good best result."""
    n, q = X.normalize_latin(F.col("label")), X.normalize_latin(F.lit(query))
    same = X.strip_article(n) == X.strip_article(q)
    score = F.when(n == q, 100.0).when(same, float(ARTICLE)).otherwise(weighted_ratio_udf(n, q))
    rows = labels.select("id", "label", "kind", score.alias("score"), same.alias("is_exact")).filter(F.col("score") >= CUTOFF)
    rows = rows.orderBy(F.desc("score"), "label", "id").limit(CANDIDATES)
    best = rows.withColumn("rn", F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "label"))).filter("rn = 1")
    top = best.orderBy(F.desc("score"), "label", "id").limit(limit).withColumn("score", F.round("score").cast("int"))
    top = top.withColumn("full", F.col("is_exact") & (F.col("score") >= 100))
    # At most ``limit`` rows from here on.
    every = F.array_sort(F.collect_list(F.struct("score", "full", "id")).over(W.partitionBy(F.lit(1))))
    tie = F.exists(every, lambda x: (x["id"] != F.col("id")) & (x["full"] | ~F.col("full")) & (F.abs(x["score"] - F.col("score")) <= MARGIN))
    first = F.row_number().over(W.orderBy(F.desc("score"), "label", "id")) == 1
    out = top.withColumn("ambiguous", tie).withColumn("first", first)
    return out.select("id", "label", F.when(F.col("is_exact"), F.col("kind")).otherwise("fuzzy").alias("match"), "score", "ambiguous", F.when(F.col("first") & (F.col("score") >= CLEAR) & ~F.col("ambiguous"), "clear").otherwise("uncertain").alias("quality"))


def names_in_text(texts: DataFrame, names: DataFrame, longest: int = 6) -> DataFrame:
    """(id, name, n): names (name, as lower-case ASCII words) found in texts as whole words, longest match first
    (a match inside a longer one does not count). Each word meets the names that begin with it in an
    equi-join, and the words after it decide."""
    words = texts.select("id", X.ascii_tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    places = F.transform(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.struct(i.alias("at"), F.get("w", i).alias("first"), F.concat(F.array_join(F.slice("w", i + 1, longest), " "), F.lit(" ")).alias("gram")))
    starts = words.select("id", F.explode(places).alias("g")).select("id", "g.*")
    index = names.select("name").distinct().select("name", F.substring_index("name", " ", 1).alias("first"), F.size(F.split("name", " ")).alias("n"))
    hits = starts.join(index, "first").filter(F.col("gram").startswith(F.concat("name", F.lit(" ")))).select("id", "at", (F.col("at") + F.col("n")).alias("end"), "name")
    w = W.partitionBy("id").orderBy("at", F.desc("end")).rowsBetween(W.unboundedPreceding, -1)
    kept = hits.withColumn("_reach", F.max("end").over(w)).filter(F.col("_reach").isNull() | (F.col("end") > F.col("_reach")))
    return kept.groupBy("id", "name").agg(F.count(F.lit(1)).alias("n"))


def mentioning(texts: DataFrame, phrase: str) -> DataFrame:
    """Texts (id, text) that hold a phrase as whole words."""
    return texts.filter(F.concat(F.lit(" "), F.array_join(X.ascii_tokens(F.col("text")), " "), F.lit(" ")).contains(f" {phrase} "))


def bm25(texts: DataFrame, query: list[str], k: int | None = None, allowed: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """Okapi BM25 of texts (id, text) for query words: (id, score) of texts that hold one, the ``k`` best
    (ties to the smaller id) or all, of the ``allowed`` ids only. Negative idf values become epsilon times
    the mean idf of all words. Document frequencies are counted over all texts, each word once a text;
    the query's words are counted where a text is read, so nothing but frequencies is shuffled."""
    words = texts.select("id", X.ascii_tokens(F.col("text")).alias("w"))
    df = words.select(F.explode(F.array_distinct("w")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    sizes = words.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size("w")).alias("avgdl"))
    idf = df.crossJoin(F.broadcast(sizes)).withColumn("idf", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))  # one row
    asked = {w: query.count(w) for w in dict.fromkeys(query)}
    value = lambda w: F.max(F.when(F.col("t") == w, F.col("idf"))).alias(f"i{list(asked).index(w)}")
    found = idf.agg(F.avg("idf").alias("mean"), F.max("avgdl").alias("avgdl"), *[value(w) for w in asked])
    rows = words if allowed is None else words.join(allowed.select("id"), "id", "left_semi")
    rows = rows.filter(F.arrays_overlap("w", F.array(*map(F.lit, asked)))).crossJoin(F.broadcast(found))  # one row
    score = F.lit(0.0)
    for i, (word, repeats) in enumerate(asked.items()):
        tf = F.size("w") - F.size(F.array_remove("w", word))
        weight = F.when(F.col(f"i{i}") < 0, epsilon * F.col("mean")).otherwise(F.col(f"i{i}"))
        term = repeats * weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.size("w") / F.col("avgdl")))
        score = score + F.when(tf > 0, term).otherwise(0.0)
    out = rows.select("id", score.alias("score"))
    return out if k is None else order_by_score(out, F.round("score", 6), k)


def chunks(texts: DataFrame) -> DataFrame:
    """Distinct paragraphs with their owners: (text_sha256, paragraph, owners)."""
    rows = texts.select("id", F.explode(F.split("text", "\n")).alias("paragraph")).filter(F.trim("paragraph") != "")
    return rows.groupBy(F.sha2("paragraph", 256).alias("text_sha256")).agg(F.min("paragraph").alias("paragraph"), F.array_sort(F.collect_set("id")).alias("owners"))


def paragraphs(texts: DataFrame) -> DataFrame:
    """(id, index, start, end, paragraph): non-empty lines with character offsets."""
    lines = F.split("text", "\n")
    starts = F.transform(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.struct(i.alias("index"), F.element_at(lines, (i + 1).cast("int")).alias("paragraph"), (F.length(F.array_join(F.slice(lines, 1, i), "\n")) + F.when(i > 0, 1).otherwise(0)).alias("start")))
    rows = texts.select("id", F.explode(starts).alias("p")).select("id", "p.*")
    return rows.filter(F.trim("paragraph") != "").withColumn("end", F.col("start") + F.length("paragraph"))


def name_index(labels: DataFrame) -> DataFrame:
    """Comparison forms that belong to exactly one node."""
    return labels.groupBy(X.normalize_latin(F.col("label")).alias("name")).agg(F.collect_set("id").alias("ids")).filter(F.size("ids") == 1).select("name", F.col("ids")[0].alias("id"))


def order_by_score(rows: DataFrame, score: Column, k: int) -> DataFrame:
    return rows.orderBy(score.desc(), "id").limit(k)
