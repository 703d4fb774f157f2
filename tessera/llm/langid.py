"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded; filters of several widths run over fixed-length windows, each filter's maximum
over the window feeds a softmax over the learned languages. A text's probabilities are the mean of
those of its windows, which cover the whole text, weighted by their bytes.

Training takes a bounded sample of labelled rows: at most about ``Config.per_language`` texts of each of
the ``Config.languages`` most frequent languages, chosen by a hash of id and text, and from each at most
``Config.per_text`` windows spread evenly over the whole text; equal windows of a language count once.
Language, source and id are never inputs of a prediction.

Defined cases: a text that is null or has no letter is ``und`` with score 1; without any labelled
row every text is ``und`` with score 0. Repeated rows are predicted row by row; rows whose ids are null or
repeat are drawn by their texts. Columns named lang_pred or score are replaced. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import hashed_id, strings, table

UND = "und"
LETTER = regex.compile(r"\p{L}")
PAD = 256


@dataclass(frozen=True)
class Config:
    window: int = 192
    embed: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 16
    languages: int = 512
    per_language: int = 600
    per_text: int = 4
    #: Passes over the sample; more of them where they come to fewer steps.
    epochs: int = 5
    steps: int = 400
    batch: int = 64
    rate: float = 4e-3
    seed: int = 7


class Network:
    """Embedding, multi-width convolution with ReLU, max pooling over the window, softmax."""

    def __init__(self, languages: list[str], config: Config):
        rng = np.random.default_rng(config.seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.languages, self.config = languages, config
        self.p = {"embed": normal(PAD + 1, config.embed, scale=0.5)}
        self.p["embed"][PAD] = 0
        for w in config.widths:
            self.p[f"conv{w}"] = normal(w * config.embed, config.filters, scale=(w * config.embed) ** -0.5)
            self.p[f"bias{w}"] = np.zeros(config.filters, np.float32)
        self.p["out"] = normal(len(config.widths) * config.filters, len(languages), scale=0.1)
        self.p["out_bias"] = np.zeros(len(languages), np.float32)

    def _columns(self, x: np.ndarray, w: int) -> np.ndarray:
        """Windows of w embedded bytes: (rows, positions, w * embed)."""
        e = self.p["embed"][x]
        view = np.lib.stride_tricks.sliding_window_view(e, w, axis=1)  # rows, positions, embed, w
        return np.ascontiguousarray(view.transpose(0, 1, 3, 2)).reshape(len(x), x.shape[1] - w + 1, -1)

    def forward(self, x: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        pooled, kept = [], {}
        for w in self.config.widths:
            c = self._columns(x, w)
            a = (c.reshape(-1, c.shape[2]) @ self.p[f"conv{w}"]).reshape(len(x), c.shape[1], -1)
            if keep:
                best = a.argmax(axis=1)
                top = np.take_along_axis(a, best[:, None], axis=1)[:, 0]
                kept[w] = (c, best)
            else:
                top = a.max(axis=1)
            pooled.append(np.maximum(top + self.p[f"bias{w}"], 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ self.p["out"] + self.p["out_bias"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        kept["h"] = h
        return z / z.sum(axis=1, keepdims=True), kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        prob, kept = self.forward(x, keep=True)
        d = prob.copy()
        d[np.arange(len(y)), y] -= 1
        d /= len(y)
        h, n, f = kept["h"], len(x), self.config.filters
        g = {"out": h.T @ d, "out_bias": d.sum(axis=0), "embed": np.zeros_like(self.p["embed"])}
        back = (d @ self.p["out"].T) * (h > 0)
        rows = np.arange(n)[:, None]
        for i, w in enumerate(self.config.widths):
            c, best = kept[w]
            own = back[:, i * f : (i + 1) * f]
            chosen = c[rows, best]  # rows, filters, w * embed: max pooling passes its gradient there alone
            g[f"conv{w}"] = np.einsum("nfk,nf->kf", chosen, own)
            g[f"bias{w}"] = own.sum(axis=0)
            to = own[:, :, None] * self.p[f"conv{w}"].T[None]
            at = x[rows[:, :, None], best[:, :, None] + np.arange(w)]
            np.add.at(g["embed"], at.ravel(), to.reshape(-1, self.config.embed))
        g["embed"][PAD] = 0
        return g

    def train(self, x: np.ndarray, y: np.ndarray) -> None:
        """Adam over shuffled batches; a quarter of the windows are cut short, so that short texts
        are learned too."""
        c, rng = self.config, np.random.default_rng(self.config.seed + 1)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        batches = -(-len(x) // c.batch)
        epochs = max(c.epochs, -(-c.steps // batches))
        step, total = 0, epochs * batches
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), c.batch):
                rows = order[i : i + c.batch]
                xb = x[rows].copy()
                cut = rng.integers(12, c.window + 1, len(rows))
                cut[rng.random(len(rows)) > 0.25] = c.window
                xb[np.arange(c.window)[None] >= cut[:, None]] = PAD
                step += 1
                rate = c.rate * (1 - 0.95 * step / total)
                for k, g in self.gradients(xb, y[rows]).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.01 * (g * g - second[k])
                    self.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def windows(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fixed-length windows that cover the whole texts: bytes, owner, bytes that are not padding."""
        size = self.config.window
        raw = [t.encode() for t in texts]
        n = np.array([len(r) for r in raw])
        count = -(-n // size)
        out = np.full((int(count.sum()), size), PAD, np.int16)
        flat = out.reshape(-1)
        start = np.concatenate([[0], np.cumsum(count)]) * size
        for r, s in zip(raw, start, strict=False):
            flat[s : s + len(r)] = np.frombuffer(r, np.uint8)
        return out, np.repeat(np.arange(len(texts)), count), (out != PAD).sum(axis=1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        score = np.zeros(len(texts))
        label = [UND] * len(texts)
        own = [i for i, t in enumerate(texts) if t is not None and LETTER.search(t)]
        score[list(set(range(len(texts))).difference(own))] = 1.0 if self.languages else 0.0
        if not own or not self.languages:
            return label, score
        total = np.zeros((len(own), len(self.languages)))
        for first in range(0, len(own), 256):
            x, at, size = self.windows([texts[i] for i in own[first : first + 256]])
            prob = np.concatenate([self.forward(x[i : i + 64])[0] for i in range(0, len(x), 64)])
            np.add.at(total, first + at, prob * size[:, None])
        total /= total.sum(axis=1, keepdims=True)
        best = total.argmax(axis=1)
        for i, b, row in zip(own, best, total, strict=True):
            label[i] = self.languages[b]
            score[i] = min(1.0, float(row[b]))
        return label, score


def learn(labelled: DataFrame, config: Config = Config(), text: str = "text", lang: str = "lang", key: str = "doc_id") -> Network:
    """Train on rows with a text and a language; see the module's bounds on the sample."""
    rows = labelled.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).filter("text is not null and lang is not null")
    spark = labelled.sparkSession
    frequent = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(config.languages).collect()
    counts = sorted((r["lang"], r["count"]) for r in frequent)
    net = Network([k for k, _ in counts], config)
    if not counts:
        return net
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), "text", F.lit("language sample")), F.lit(1_000_000)) / 1_000_000
    share = spark.createDataFrame([(k, config.per_language / n) for k, n in counts], "lang string, share double")
    drawn = rows.join(F.broadcast(share), "lang").filter(draw < F.col("share"))  # at most Config.languages rows
    # Only windows of the sampled texts reach the driver: a fixed number of bytes for each language.
    size = F.length("text")
    spread = F.transform(F.sequence(F.lit(0), F.lit(config.per_text - 1)), lambda i: F.substring("text", F.greatest(F.lit(0), F.floor((size - config.window) * i / max(config.per_text - 1, 1))).cast("int") + 1, F.lit(config.window)))
    sample = drawn.select("lang", F.array_distinct(spread).alias("parts")).dropDuplicates().collect()
    sample.sort(key=lambda r: (r["lang"], r["parts"]))
    pairs = [(p, r["lang"]) for r in sample for p in r["parts"] if LETTER.search(p)]
    if not pairs:
        net.languages = []
        return net
    x = np.full((len(pairs), config.window), PAD, np.int16)
    for row, (p, _) in zip(x, pairs, strict=True):
        raw = np.frombuffer(p.encode()[: config.window], np.uint8)
        row[: len(raw)] = raw
    place = {k: i for i, k in enumerate(net.languages)}
    net.train(x, np.array([place[k] for _, k in pairs]))
    return net


def predict(df: DataFrame, net: Network, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Append lang_pred and score, which replace columns of those names."""
    names = [c for c in df.columns if c not in ("lang_pred", "score")]
    held = [c for c in names if keep_text or c != text]
    source = df.select(*[F.col(f"`{c}`") for c in names])
    schema = T.StructType([source.schema[c] for c in held] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                label, score = net.predict(strings(b.column(names.index(text))).to_pylist())
                yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in held], pa.array(label, pa.string()), pa.array(score)], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = learn(docs.filter(hashed_id(F.col("doc_id")) % 3 != 1))
    held_out = (hashed_id(F.col("doc_id")) % 3 == 1).alias("held_out")
    return predict(docs.select("doc_id", held_out, "text"), net)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str, least: float = 0.5) -> DataFrame:
    """Pipeline stage: documents without a language, or of an uncertain one, go."""
    net = learn(docs)
    rest = [c for c in docs.columns if c != "text"]
    named = predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), "text"), net, keep_text=True)
    kept = named.filter((F.col("lang_pred") != UND) & (F.col("score") >= least))
    return kept.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
