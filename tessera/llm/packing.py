"""Lexical retrieval packing with a sharded BM25 inverted index.

Documents become token ids. Whole windows of a long document are sequences of their own; what is
left of each document (its tail) is packed with its lexical neighbours. Document frequencies and lengths
are counted over all documents, whole texts. Of the tokens that two documents or more hold, a document's
rarest ones decide where it goes: it is routed by the one of the highest BM25 weight among those that no
more than a shard of documents hold (where there is none, by the rarest), and tails that go by the same
token lie next to each other, in any order of the input. Every task packs its share of that order in shards
of ``Config.shard`` tails: a shard's inverted index maps each token of its documents' whole texts to them. A
seed queries the index; unused neighbours, best BM25 score first, fill its window. The last one is cut
where the window ends, and its rest is the next seed, so windows carry no padding. The few tokens left
at a task's end are cut into sequences whose lengths are powers of two, which need none either.

Texts are tokenised once and stored; only tails are shuffled, by their token. A token that more documents
hold than a shard has is split into as many parts as it has shards, by the documents' numbers, so no
token, nor group of copies, gathers more than about a shard. Sequence ids
are unique over partitions: partition << 33 | counter, and 1 << 62 more for sequences of tails.

Defined cases: a null text is empty; it is one piece, id 0 alone. Repeated rows and repeated ids are
documents of their own; ties follow the order of the input's partitions. ``<|endoftext|>`` in a text is its
own id, as the tokenizer has it. An empty table gives an empty result. Other columns are ignored; a key
that is named as a column of the result is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import parts, scratch_path, strings, table, trimmed

SPECIAL = "<|endoftext|>"
#: Characters on which all versions of the Unicode tables agree, so that either library cuts alike.
PLAIN = regex.compile(r"[\x00-ɏḀ-ỿ‐-‧‰-›₠-₿]*")
PIECE = [("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


@dataclass(frozen=True)
class Config:
    size: int = 1024
    end_id: int = 0
    shard: int = 512
    k1: float = 1.2
    b: float = 0.75


class Tokenizer:
    """Ids of the tokenizers library. Texts of common characters go through tiktoken with the same
    vocabulary and pattern, which gives the same ids several times faster; all others, and texts
    that hold the special token, through tokenizers itself."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Full

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.full = Full.from_file(json_path)

    def ids(self, text: str) -> np.ndarray:
        if SPECIAL not in text and PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, np.uint32)


_tokenizers: dict[tuple[str, str, str], Tokenizer] = {}


@dataclass
class Counts:
    """Of all documents: how many hold each token, how many there are, their mean length."""

    df: np.ndarray
    n: int
    mean: float

    def idf(self, token: np.ndarray) -> np.ndarray:
        df = self.df[token]
        return np.log((self.n - df + 0.5) / (df + 0.5))

    def weights(self, token: np.ndarray, count: np.ndarray, size: np.ndarray | int, config: Config) -> np.ndarray:
        """BM25 weight of each token in a document of so many tokens."""
        norm = config.k1 * (1 - config.b + config.b * size / self.mean)
        return self.idf(token) * count * (config.k1 + 1) / (count + norm)

    def route(self, token: np.ndarray, count: np.ndarray, size: int, config: Config) -> tuple[int, int]:
        """The token by which a document is dealt, -1 if no other document holds one of its tokens; and the
        number of parts into which the documents of that token are split."""
        df = self.df[token]
        rare = (df > 1) & (df <= config.shard)
        if rare.any():
            own = token[rare]
            return int(own[self.weights(own, count[rare], size, config).argmax()]), 1
        shared = token[(df > 1) & (2 * df < self.n)]
        if not len(shared):
            return -1, -(-self.n // config.shard)
        rarest = int(shared[self.df[shared].argmin()])
        return rarest, -(-int(self.df[rarest]) // config.shard)


@dataclass
class Tail:
    """What is left of a document, from token ``start`` on; its whole text's distinct tokens."""

    key: object
    start: int
    ids: np.ndarray
    total: int
    token: np.ndarray
    count: np.ndarray


class Index:
    """BM25 inverted index of one shard, over whole texts. Tokens in half of all documents or more say
    nothing and are left out, as their weight would not be positive."""

    def __init__(self, tails: list[Tail], counts: Counts, config: Config):
        n = len(tails)
        doc = np.repeat(np.arange(n, dtype=np.int64), [len(t.token) for t in tails])
        token, count = np.concatenate([t.token for t in tails]).astype(np.int64), np.concatenate([t.count for t in tails])
        keep = counts.idf(token) > 0
        doc, token, count = doc[keep], token[keep], count[keep]
        vocabulary, term = np.unique(token, return_inverse=True)
        weight = counts.weights(token, count, np.array([t.total for t in tails])[doc], config)
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(vocabulary)))])
        self.terms = np.split(term, np.searchsorted(doc, np.arange(1, n)))
        self.n = n

    def scores(self, seed: int) -> np.ndarray:
        """BM25 score of every document for the seed's tokens, each counted once."""
        terms = self.terms[seed]
        begin, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n).astype(float)


class Packer:
    """Pieces of one task, in the order in which their sequences are filled."""

    def __init__(self, config: Config, first_id: int):
        self.config, self.next, self.filled, self.room = config, first_id, 0, 0
        self.out: list[tuple] = []

    def piece(self, row: object, start: int, ids: np.ndarray, total: int, sequence: int, offset: int) -> None:
        self.out.append((row, start, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))

    def add(self, row: object, start: int, ids: np.ndarray, total: int) -> tuple[int, np.ndarray] | None:
        """Put ids into the open window. Returns what the window has no room for."""
        take = min(len(ids), self.config.size - self.filled)
        self.piece(row, start, ids[:take], total, self.next, self.filled)
        self.filled += take
        if self.filled == self.config.size:
            self.next, self.filled = self.next + 1, 0
        return (start + take, ids[take:]) if take < len(ids) else None

    def shard(self, tails: list[Tail], counts: Counts) -> list[Tail]:
        """Pack the tails of a shard; returns those that do not fill a last window."""
        if not tails:
            return []
        index = Index(tails, counts, self.config)
        left = np.array([len(t.ids) for t in tails])
        unused = np.ones(len(tails), bool)
        remaining, following, last = int(left.sum()), 0, -1
        while remaining >= self.config.size:
            while not unused[following]:
                following += 1
            # The rest of a cut tail seeds the next window, else the first unused tail does.
            seed = last if last >= 0 and unused[last] else following
            rank = index.scores(seed)
            rank[~unused] = -1
            rank[seed] = np.inf
            for i in np.argsort(-rank, kind="stable"):
                t = tails[i]
                unused[i] = False
                before = self.next
                remaining -= min(len(t.ids), self.config.size - self.filled)
                rest = self.add(t.key, t.start, t.ids, t.total)
                if rest is not None:
                    t.start, t.ids = rest
                    unused[i] = True
                if self.next != before:
                    last = int(i)
                    break
        return [t for t, u in zip(tails, unused, strict=True) if u]

    def finish(self, tails: list[Tail]) -> None:
        """Cut what is left, less than a window, into sequences of powers of two."""
        remaining = sum(len(t.ids) for t in tails)
        for t in tails:
            row, start, ids, total = t.key, t.start, t.ids, t.total
            while len(ids):
                if not self.filled:
                    self.room = 1 << (remaining.bit_length() - 1)
                take = min(len(ids), self.room - self.filled)
                self.piece(row, start, ids[:take], total, self.next, self.filled)
                self.filled += take
                remaining -= take
                start, ids = start + take, ids[take:]
                if self.filled == self.room:
                    self.next, self.filled = self.next + 1, 0


#: Rows of the stored table: whole windows, tails, and each task's document frequencies.
WINDOW, TAIL, FREQUENCIES = 0, 1, 2
STORED = "kind int, start long, ids binary, doc_tokens long, sequence_id long, tokens binary, counts binary"


def tokenised(source: DataFrame, names: tuple[str, str, str], config: Config) -> DataFrame:
    """Rows (key, STORED) of (key, text). Of frequencies, ``start`` counts documents, ``doc_tokens`` tokens;
    of tails, ``sequence_id`` numbers documents."""
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(STORED).fields])
    types = [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    pack = lambda x: x.astype("<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizers.get(names) or _tokenizers.setdefault(names, Tokenizer(*names))
        base = TaskContext.get().partitionId() << 33
        end = np.array([config.end_id], np.uint32)
        df = np.zeros(1, np.int64)
        n = size = made = 0
        rows: list[tuple] = []
        held, kind = 0, None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, t) for c, t in zip(columns[1:], types, strict=True)]], names=schema.names)

        for b in batches:
            kind = b.column(0).type
            keys, texts = b.column(0).to_pylist(), strings(b.column(1))
            for i, key in enumerate(keys):
                ids = np.concatenate([tokenizer.ids(texts[i].as_py()), end])
                token, count = np.unique(ids, return_counts=True)
                if token[-1] >= len(df):
                    df = np.pad(df, (0, int(token[-1]) + 1 - len(df)))
                df[token] += 1
                whole = len(ids) // config.size * config.size
                for at in range(0, whole, config.size):
                    rows.append((key, WINDOW, at, pack(ids[at : at + config.size]), len(ids), base + made, None, None))
                    made += 1
                if whole < len(ids):
                    rows.append((key, TAIL, whole, pack(ids[whole:]), len(ids), base + n, pack(token), pack(count)))
                n, size, held = n + 1, size + len(ids), held + 4 * len(ids)
                if held > 1 << 22 or len(rows) >= 1000:
                    yield emit()
                    rows, held = [], 0
        if n:
            token = np.flatnonzero(df)
            rows.append((None, FREQUENCIES, n, None, size, base, pack(token), pack(df[token])))
            yield emit()

    return source.mapInArrow(trimmed(run), schema)


def frequencies(stored: DataFrame) -> Counts:
    """Summed over all tasks; at most as many rows as the vocabulary has reach the driver."""
    found = stored.filter(F.col("kind") == FREQUENCIES)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for token, count in zip(b.column(0), b.column(1), strict=True):
                columns = [np.frombuffer(x.as_buffer(), "<u4").astype(np.int64) for x in (token, count)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "n"])

    sums = found.select("tokens", "counts").mapInArrow(spread, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toArrow()
    token, count = (sums.column(c).to_numpy().astype(np.int64) for c in ("token", "n"))
    df = np.zeros(int(token.max(initial=0)) + 1, np.int64)
    df[token] = count
    total = found.agg(F.sum("start").alias("n"), F.sum("doc_tokens").alias("size")).first()
    return Counts(df, total["n"] or 0, (total["size"] or 1) / (total["n"] or 1))


def routed(tails: DataFrame, counts: Counts, config: Config) -> DataFrame:
    """Tails with the token, and the part of its documents, by which each is dealt."""
    schema = T.StructType([*tails.schema.fields, T.StructField("route", T.LongType()), T.StructField("part", T.LongType())])
    shared = tails.sparkSession.sparkContext.broadcast(counts)  # bounded by the vocabulary
    at = tails.columns.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column(at("tokens")), b.column(at("counts")), b.column(at("doc_tokens")).to_pylist(), strict=True)
            found = [shared.value.route(np.frombuffer(t.as_buffer(), "<u4"), np.frombuffer(c.as_buffer(), "<u4"), size, config) for t, c, size in rows]
            route, n_parts = np.array(found, np.int64).reshape(-1, 2).T
            number = b.column(at("sequence_id")).to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route), pa.array((number + (number >> 33)) % np.maximum(n_parts, 1))], names=schema.names)

    return tails.mapInArrow(run, schema)


def pack(df: DataFrame, json_path: str, ranks_path: str, pattern: str, config: Config = Config(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per piece: the key and SCHEMA; ids are little-endian unsigned 32-bit."""
    if key in T.StructType.fromDDL(SCHEMA).names:
        raise ValueError(f"{key} is a column of the result")
    spark = df.sparkSession
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    made, path = tokenised(source, (json_path, ranks_path, pattern), config), scratch_path(spark, "tokens")
    made.write.partitionBy("kind").parquet(path)
    stored = spark.read.schema(made.schema).parquet(path)
    counts = frequencies(stored)
    names = [f.name for f in T.StructType.fromDDL(SCHEMA).fields]
    shape = [F.col("key").alias(key), *names]
    windows = stored.filter(F.col("kind") == WINDOW).select("key", "start", F.lit(config.size).cast("long").alias("length"), "ids", "doc_tokens", "sequence_id", F.lit(0).cast("long").alias("offset"))
    tails = stored.filter(F.col("kind") == TAIL).select("key", "start", "ids", "doc_tokens", "sequence_id", "tokens", "counts")
    dealt = routed(tails, counts, config).repartition(parts(spark, counts.n), "route", "part").sortWithinPartitions("route", "part", "sequence_id")
    schema = T.StructType([source.schema["key"], *T.StructType.fromDDL(SCHEMA).fields])
    shared = spark.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _tokenizers.clear()  # all is tokenised: about 60 MB a worker
        packer = Packer(config, (1 << 62) + (TaskContext.get().partitionId() << 33))
        tails: list[Tail] = []
        kind = None

        def emit() -> pa.RecordBatch:
            columns = list(zip(*packer.out, strict=True))
            packer.out = []
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *[pa.array(c, t) for c, (_, t) in zip(columns[1:], PIECE, strict=True)]], names=schema.names)

        for b in batches:
            kind = b.column(0).type
            for r in b.to_pylist():
                ids, token, count = (np.frombuffer(r[c], "<u4") for c in ("ids", "tokens", "counts"))
                tails.append(Tail(r["key"], r["start"], ids, r["doc_tokens"], token, count))
                if len(tails) >= config.shard:
                    tails = packer.shard(tails, shared.value)
                if len(packer.out) >= 1000:
                    yield emit()
        packer.finish(packer.shard(tails, shared.value))
        if packer.out:
            yield emit()

    return windows.unionByName(dealt.mapInArrow(trimmed(run), schema)).select(*shape)


def packed(docs: DataFrame) -> DataFrame:
    """pack() with the public 50k vocabulary."""
    import public_tokenizers as p

    return pack(docs, p.path("byte_bpe_50k.json"), p.path("byte_bpe_50k.tiktoken"), p.PATTERN)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: every remaining document's pieces."""
    return packed(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
