"""Toxicity by class-conditional Kneser-Ney word models.

Two interpolated bigram models, of toxic and of ordinary text, are compared on every text. A class's
bigrams back off to bigrams of both classes, those to the class's continuation counts (the number of
different words before a word), those to continuation counts of both classes, and those to a uniform
level for words unknown to both. As Kneser-Ney has it, a level that two classes share counts what they
give up, not all they have: an expression counts there for each class up to the class's discount, so
that one which a single class knows well stays that class's own. What only a
few texts of a class hold (``Config.rare`` of them, three at least) is given up whole, so a rare
expression is smoothed by counts that both classes share, and says little; the shared levels themselves give up the modified Kneser-Ney discounts, estimated
from counts of counts. Expressions are counted once for each different text.

The log-likelihood ratio is normalised by length: over the whole text, and over phrases of
``Config.phrase`` words, of which the highest counts, so that a short passage is found in a long
text. A logistic curve over these two, fitted on out-of-fold ratios, gives the score; neither may count
against toxicity.

The models learn from a bounded sample of labelled rows: about ``Config.per_class`` texts and at most
about ``Config.chars`` characters of each class, drawn by hashes of the id and, where ids repeat, of the
text. Equal texts of one label count once. Labels, language, source and id are never inputs of a score.

Defined cases: texts without a word, null ones included, score the share of label 1 among the
labelled rows (0 without any); without rows of both classes every text scores that share. Rows that
repeat are scored row by row; columns named score or predicted are replaced. A key with both labels
counts for both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkernel as K
from tessera.llm.common import hashed_id, table

U = K.U


@dataclass(frozen=True)
class Config:
    per_class: int = 4000
    chars: int = 6_000_000
    #: The share of a class's texts that an expression must exceed to be the class's own.
    rare: float = 0.004
    phrase: int = 3
    folds: int = 4


def tokens(t: K.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lower-case texts, and the text that each belongs to."""
    s, e, own = t.spans(K.LETTER[t.data])
    return K.hashes(t.prefix(), s, e), own


def _pairs(h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose word follows another of the same text, and the bigrams' hashes."""
    at = np.flatnonzero(own[1:] == own[:-1]) + 1
    with np.errstate(over="ignore"):
        return at, K.mix(h[at - 1] * U(0xC2B2AE3D27D4EB4F) + h[at])


def _find(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Index of each x in sorted keys, len(keys) if absent."""
    if not len(keys):
        return np.zeros(len(x), np.int64)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, at, len(keys))


def _once(which: np.ndarray, texts: np.ndarray, n: int) -> np.ndarray:
    """For each of n kinds, in how many different texts it occurs."""
    pairs = np.unique((texts.astype(np.int64) * max(n, 1)) + which)
    return np.bincount(pairs % max(n, 1), minlength=n)[:n] if len(pairs) else np.zeros(n, np.int64)


def modified_discounts(counts: np.ndarray) -> np.ndarray:
    """What counts of 0, 1, 2, and 3 or more give up: modified Kneser-Ney, from counts of counts. Where
    those are too few for the estimate, three quarters of each count's least value."""
    n = np.bincount(np.minimum(counts, 5).astype(np.int64), minlength=6).astype(float)
    if not n[1:5].all():
        return np.array([0.0, 0.75, 1.5, 2.25])
    y = n[1] / (n[1] + 2 * n[2])
    return np.array([0.0, *[np.clip(k - (k + 1) * y * n[k + 1] / n[k], 0.0, k) for k in (1, 2, 3)]])


def class_discounts(own: np.ndarray, toxic: np.ndarray, config: Config) -> np.ndarray:
    """What class counts of 0, 1, 2, ... texts give up; the last stands for all higher ones."""
    texts = min(len(np.unique(own[toxic])), len(np.unique(own[~toxic])))
    return np.arange(max(3, round(config.rare * texts)) + 1, dtype=float)


def _given(counts: np.ndarray, discounts: np.ndarray) -> np.ndarray:
    return discounts[np.minimum(counts, len(discounts) - 1).astype(np.int64)]


def _level(counts: np.ndarray, discounts: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """A distribution over words and the unknown one (last), interpolated with a lower one."""
    total = counts.sum()
    if not total:
        return lower
    given = _given(counts, discounts)
    return np.append(counts - given, 0.0) / total + given.sum() / total * lower


def _bigrams(counts: np.ndarray, left: np.ndarray, n: int, discounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each bigram after its first word (last: an unseen one), and the weight of the
    lower level after each word (last: an unknown one)."""
    given = _given(counts, discounts)
    total = np.bincount(left, weights=counts, minlength=n)
    weight = np.where(total > 0, np.bincount(left, weights=given, minlength=n) / np.maximum(total, 1), 1.0)
    return np.append((counts - given) / np.maximum(total[left], 1), 0.0), np.append(weight, 1.0)


@dataclass
class Ratios:
    """Both models. Last entries stand for unknown words and unseen bigrams; tables of two rows hold the
    toxic class first."""

    words: np.ndarray
    word: np.ndarray  # 2 x words: p(word), where no word precedes and as the lower level
    bigrams: np.ndarray
    own: np.ndarray  # 2 x bigrams: the class's discounted share
    own_weight: np.ndarray  # 2 x words: weight of the shared bigrams after a word
    shared: np.ndarray
    shared_weight: np.ndarray

    def logs(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        """log p(word | the word before) of every word, in both classes."""
        w = _find(self.words, h)
        p = self.word[:, w]
        at, pair = _pairs(h, own)
        if len(at):
            b, before = _find(self.bigrams, pair), w[at - 1]
            p[:, at] = self.own[:, b] + self.own_weight[:, before] * (self.shared[b] + self.shared_weight[before] * p[:, at])
        return np.log(p)

    def per_word(self, h: np.ndarray, own: np.ndarray) -> np.ndarray:
        toxic, ordinary = self.logs(h, own)
        return toxic - ordinary


def train(h: np.ndarray, own: np.ndarray, toxic: np.ndarray, config: Config) -> Ratios:
    """Both models from hashed words; ``own`` is each word's text and ``toxic`` its class."""
    words, index = np.unique(h, return_inverse=True)
    at, pair = _pairs(h, own)
    bigrams, first, which = np.unique(pair, return_index=True, return_inverse=True)
    left, right, n = index[at - 1][first], index[at][first], len(words)
    counts = np.stack([_once(which[toxic[at] == c], own[at][toxic[at] == c], len(bigrams)) for c in (True, False)])
    continued = np.stack([np.bincount(right[c > 0], minlength=n) for c in counts])
    given = class_discounts(own, toxic, config)
    both, pairs = _given(continued, given).sum(axis=0), _given(counts, given).sum(axis=0)
    lowest = _level(both, modified_discounts(both), np.full(n + 1, 1 / (n + 1)))
    shared, shared_weight = _bigrams(pairs, left, n, modified_discounts(pairs))
    word = np.stack([_level(c, given, lowest) for c in continued])
    parts = [_bigrams(c, left, n, given) for c in counts]
    return Ratios(words, word, bigrams, np.stack([p[0] for p in parts]).astype(np.float32), np.stack([p[1] for p in parts]), shared.astype(np.float32), shared_weight)


def features(r: Ratios, h: np.ndarray, own: np.ndarray, n: int, phrase: int) -> np.ndarray:
    """Per text: the mean ratio, and the highest mean ratio of a phrase; NaN without words. A shorter
    text is its only phrase, filled up with words that say nothing."""
    out = np.full((n, 2), np.nan)
    if not len(h):
        return out
    total = np.concatenate([[0.0], np.cumsum(r.per_word(h, own), dtype=np.float64)])
    texts, start, size = np.unique(own, return_index=True, return_counts=True)
    end = start + size
    out[texts, 0] = (total[end] - total[start]) / size
    low, stop = np.repeat(start, size), np.minimum(np.arange(len(h)) + phrase, np.repeat(end, size))
    begin = np.maximum(low, stop - phrase)
    out[texts, 1] = np.maximum.reduceat((total[stop] - total[begin]) / phrase, start)
    return out


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted logistic regression by Newton's method; the last coefficient is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (w * (y - p)) - ridge * b
        step = np.linalg.solve((x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(b)), g)
        b = b + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return b


def curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """logistic(), where no feature counts against label 1: one that would is left out."""
    use = np.arange(x.shape[1])
    while True:
        b = logistic(x[:, use], y, w)
        if not len(use) or (b[:-1] >= 0).all():
            out = np.zeros(x.shape[1] + 1)
            out[use], out[-1] = b[:-1], b[-1]
            return out
        use = np.delete(use, int(b[:-1].argmin()))


@dataclass
class Model:
    share: float
    ratios: Ratios | None
    curve: np.ndarray | None
    phrase: int

    def score(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), self.share)
        if self.ratios is None:
            return out
        for t in K.lowered_runs(texts):
            x = features(self.ratios, *tokens(t), len(t), self.phrase)
            has = ~np.isnan(x[:, 0])
            z = np.column_stack([x[has], np.ones(has.sum())]) @ self.curve
            out[t.first : t.first + len(t)][has] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def learn(docs: DataFrame, labels: DataFrame, config: Config = Config(), text: str = "text", label: str = "toxic", key: str = "doc_id") -> Model:
    """Learn from the texts of ``docs`` and the labels of ``labels``, which share ``key``. Labels are
    counted over all rows; the sample of keys is drawn before any text is read and its bound lets it
    be a broadcast, so that only texts of the sample are shuffled."""
    known = labels.select(F.col(f"`{key}`").cast("string").alias("key"), F.col(f"`{label}`").cast("int").alias("label")).filter("key is not null and label in (0, 1)")
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    total = sum(sizes.values())
    model = Model(sizes.get(1, 0) / total if total else 0.0, None, None, config.phrase)
    if len(sizes) < 2:
        return model
    draw = lambda *c: F.pmod(F.xxhash64(*c), F.lit(1_000_000)) / 1_000_000
    below = lambda part: F.when(F.col("label") == 1, part[1]).otherwise(part[0])
    part = {c: min(1.0, config.per_class / n) for c, n in sizes.items()}
    drawn = known.filter(draw("key", F.lit("toxicity sample")) < below(part)).distinct()  # about 2 * per_class keys
    texts = docs.select(F.col(f"`{key}`").cast("string").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(drawn), "key").select("text", "label").dropDuplicates()
    found = {r["label"]: r for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars")).collect()}
    # Ids that repeat may bring more texts than were drawn: those are drawn by their text.
    bound = lambda r: min(1.0, config.chars / max(1, r["chars"]), 2 * config.per_class / r["n"])
    again = {c: bound(found[c]) if c in found else 1.0 for c in (0, 1)}
    got = sample.filter(draw("text", F.lit("toxicity text")) < below(again)).toArrow()
    got = got.sort_by([("text", "ascending"), ("label", "ascending")]).combine_chunks()
    h, own = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for t in K.lowered_runs(got.column("text").combine_chunks()):
        th, to = tokens(t)
        h.append(th)
        own.append(to + t.first)
    h, own = np.concatenate(h), np.concatenate(own)
    y = got.column("label").to_numpy() == 1
    if not len(h) or y[own].all() or not y[own].any():
        return model
    # Copies of a text share a fold, so that none is scored by a model that has seen it.
    digest = np.zeros(len(y), U)
    with np.errstate(over="ignore"):
        np.add.at(digest, own, K.mix(h))
    text_of = np.unique(digest, return_inverse=True)[1]
    fold = (K.mix(digest) % U(config.folds)).astype(np.int64)
    x = np.full((len(y), 2), np.nan)
    for f in range(config.folds):
        inside = fold[own] == f
        if inside.any() and not inside.all():
            part_model = train(h[~inside], text_of[own[~inside]], y[own][~inside], config)
            out = features(part_model, h[inside], own[inside], len(y), config.phrase)
            x = np.where(np.isnan(out), x, out)
    has = ~np.isnan(x[:, 0])
    if not has.any():
        return model
    weight = np.where(y, 1 / (part[1] * again[1]), 1 / (part[0] * again[0]))
    model.curve = curve(x[has], y[has].astype(float), weight[has] / weight[has].mean())
    model.ratios = train(h, text_of[own], y[own], config)
    return model


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Replace ``text`` by score and predicted. The model, whose size the sample bounds, is a broadcast."""
    held = [c for c in df.columns if c not in (text, "score", "predicted")]
    source = df.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").alias(text))
    schema = T.StructType([source.schema[c] for c in held] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                s = shared.value.score(b.column(len(held)))
                yield pa.RecordBatch.from_arrays([*b.columns[: len(held)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(hashed_id(F.col("doc_id")) % 4 != 2)
    model = learn(docs, seen)
    return score(docs.select("doc_id", (hashed_id(F.col("doc_id")) % 4 == 2).alias("held_out"), "text"), model)
