"""Quality rules as weak supervision.

Every rule votes good, bad or abstains on a document. Expectation-maximisation over the counts of
all vote patterns (at most 3**rules of them, whatever the corpus size) estimates how often each
rule that votes is right on good and on bad documents; the posterior probability of "good" decides,
instead of demanding that every rule passes. Rules overlap on purpose: junk that is one fails several, so
that agreement, which is all that EM sees, tells a rule's finding from its noise. A lone bad vote is
outvoted where the rules that agree with each other say good.

Null or empty texts have no words, fail the base rules and are not kept. Repeated rows are judged
row by row. Columns of the input that clash with the features are replaced by them. Patterns are
judged, not rows, so ties have one verdict. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textkernel as K
from tessera.llm.common import materialize

FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_symbol_words", "n_letter_words", "n_word_letters")
GOOD, BAD, ABSTAIN = 1, -1, 0


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


SYMBOL = _flags(b"#*$%&|<>")
UPPER, LOWER = _flags(bytes(range(65, 91))), _flags(bytes(range(97, 123)))
#: First bytes of letters; every character beyond ASCII counts as one.
LETTER = UPPER | LOWER | _flags(bytes(range(0xC0, 256)))


def _sums(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Counts of set flags between consecutive bounds."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[at])


def _within(mask: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """Counts of set flags in the slices [s, e)."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[e] - total[s]


def _duplicates(keys: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Flags every key that occurs at least twice within its own text."""
    with np.errstate(over="ignore"):
        k = K.mix(keys + own.astype(K.U) * K.U(0xA0761D6478BD642F))
    order = np.argsort(k)
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[order][1:] == k[order][:-1]
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


def measure(t: K.Texts) -> np.ndarray:
    """The features of each text of a run, one row per text, in the order of FEATURES."""
    n = len(t)
    word = ~K.SPACE[t.data]
    s, e, own = t.spans(word)
    prefix = t.prefix()
    h = K.hashes(prefix, s, e)
    first, tri = K.windows(h, own, 3)
    again = first[_duplicates(tri, own[first])]
    covered = np.zeros(len(s), bool)
    for j in range(3):
        covered[again + j] = True
    ls, le, lown = t.lines()
    has = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, lown = ls[has], le[has], lown[has]
    with np.errstate(over="ignore"):
        lines = K.mix(K.hashes(prefix, ls, le) + lown.astype(K.U) * K.U(0xA0761D6478BD642F))
    distinct = lown[np.unique(lines, return_index=True)[1]]
    n_lines = np.bincount(lown, minlength=n)
    upper = UPPER[t.data]
    letters = _within(LETTER[t.data], s, e)
    return np.stack(
        [
            np.bincount(own, minlength=n),
            _sums(word & ((t.data & 0xC0) != 0x80), t.at),
            _sums(SYMBOL[t.data], t.at),
            n_lines - np.bincount(distinct, minlength=n),
            np.bincount(own, weights=covered, minlength=n).astype(np.int64),
            n_lines,
            _sums(upper, t.at),
            _sums(upper | LOWER[t.data], t.at),
            np.bincount(own[_within(SYMBOL[t.data], s, e) > 0], minlength=n),
            np.bincount(own[letters > 0], minlength=n),
            np.bincount(own, weights=letters, minlength=n).astype(np.int64),
        ],
        axis=1,
    )


def with_features(df: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Append FEATURES to every row; ``keep_text`` False drops the text on the way out."""
    names = [c for c in df.columns if c not in FEATURES]
    held = [c for c in names if keep_text or c != text]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([source.schema[c] for c in held] + [T.StructField(f, T.LongType()) for f in FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [measure(t) for t in K.runs(b.column(names.index(text)))]
            rows = np.concatenate(found) if found else np.zeros((0, len(FEATURES)), np.int64)
            columns = [b.column(names.index(c)) for c in held] + [pa.array(rows[:, i]) for i in range(len(FEATURES))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """Votes bad beyond ``bad``, good within ``good``, else abstains; ``value`` is SQL over FEATURES."""

    name: str
    value: str
    good: str
    bad: str

    def vote(self) -> Column:
        sql = lambda test: F.expr(test.replace("x", f"({self.value})"))
        return F.when(sql(self.bad), F.lit(BAD)).when(sql(self.good), F.lit(GOOD)).otherwise(F.lit(ABSTAIN))


RULES = (
    Rule("length", "n_words", "x >= 80", "x < 50"),
    Rule("word_length", "word_chars / greatest(n_words, 1)", "x between 3.5 and 7", "x < 2.5 or x > 10"),
    Rule("symbols", "n_symbols / greatest(n_words, 1)", "x < 0.02", "x > 0.1"),
    Rule("symbol_words", "n_symbol_words / greatest(n_words, 1)", "x < 0.02", "x > 0.1"),
    Rule("letter_words", "n_letter_words / greatest(n_words, 1)", "x > 0.9", "x < 0.8"),
    Rule("letters", "n_word_letters / greatest(word_chars, 1)", "x > 0.9", "x < 0.8"),
    Rule("repeated_lines", "n_dup_lines / greatest(n_lines, 1)", "x < 0.05", "x > 0.3"),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", "x < 0.1", "x > 0.3"),
    Rule("capitals", "n_upper / greatest(n_letters, 1)", "x < 0.15", "x > 0.4"),
    Rule("line_words", "n_words / greatest(n_lines, 1)", "x > 5", "x < 2.5"),
)
BASE_FAILED = "n_words < 50 or 100 * n_repeat_words > 50 * n_words"


@dataclass
class LabelModel:
    """P(good) and, per rule, P(bad vote | the rule votes) on bad (first) and on good documents. An
    abstention is no evidence."""

    prior: float
    bad: np.ndarray  # 2 classes x rules

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(good | votes) of each row of votes."""
        said = [np.where(votes == BAD, np.log(p), np.where(votes == GOOD, np.log1p(-p), 0.0)).sum(axis=1) for p in self.bad]
        odds = np.log(self.prior) - np.log1p(-self.prior) + said[1] - said[0]
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))

    def accuracies(self) -> np.ndarray:
        """P(vote is right | the rule votes), under the model."""
        return self.prior * (1 - self.bad[1]) + (1 - self.prior) * self.bad[0]


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> LabelModel:
    """EM over vote patterns. It starts from the rules' own meaning, any bad vote: probably bad; what
    the votes are worth is estimated. One vote of each kind is added to each rule and class, which
    keeps every probability positive. Good is the class in which bad votes are rarer."""
    votes, counts = np.asarray(votes, np.int64), np.asarray(counts, np.float64)
    good = np.where((votes == BAD).any(axis=1), 0.25, 0.9)
    against, voting = (votes == BAD).astype(float), (votes != ABSTAIN).astype(float)
    total = max(counts.sum(), 1.0)
    model = LabelModel(0.5, np.full((2, votes.shape[1]), 0.5))
    for _ in range(rounds):
        w = np.stack([counts * (1 - good), counts * good])
        model = LabelModel(float(np.clip(w[1].sum() / total, 0.02, 0.98)), (w @ against + 1) / (w @ voting + 2))
        new = model.posterior(votes)
        if np.abs(new - good).max(initial=0) < 1e-9:
            break
        good = new
    if model.bad[0].sum() < model.bad[1].sum():
        model = LabelModel(1 - model.prior, model.bad[::-1])
    return model


def judge(features: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Add base_failed, quality (posterior) and kept to rows that carry FEATURES. All rows are
    counted; only the vote patterns reach the driver."""
    spark = features.sparkSession
    names = [f"_vote_{r.name}" for r in rules]
    votes = features.select("*", *[r.vote().cast("int").alias(n) for r, n in zip(rules, names, strict=True)])
    rows = votes.groupBy(*names).count().collect()
    patterns = np.array([[r[n] for n in names] for r in rows], np.int64).reshape(-1, len(names))
    posterior = fit(patterns, np.array([r["count"] for r in rows])).posterior(patterns) if rows else np.zeros(0)
    schema = T.StructType([T.StructField(n, T.IntegerType(), False) for n in names] + [T.StructField("quality", T.DoubleType(), False)])
    scored = spark.createDataFrame([(*map(int, p), float(q)) for p, q in zip(patterns, posterior, strict=True)], schema)
    # At most 3**len(rules) rows, whatever the corpus size.
    joined = votes.join(F.broadcast(scored), names, "left")
    failed = F.expr(BASE_FAILED)
    return joined.select(*[F.col(f"`{c}`") for c in features.columns], failed.alias("base_failed"), "quality", (~failed & (F.col("quality") >= threshold)).alias("kept"))


def quality(df: DataFrame, text: str = "text") -> DataFrame:
    """Features, posterior quality and verdict of every row, without the text."""
    return judge(materialize(with_features(df, text), "quality"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: only documents with a good verdict stay, with their own columns. The
    features are measured once to count vote patterns and again, beside the text, to decide."""
    rest = [c for c in docs.columns if c != "text"]
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text")
    judged = judge(with_features(marked, keep_text=True))
    return judged.filter("kept").select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
