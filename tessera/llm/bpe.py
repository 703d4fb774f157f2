"""Byte-level BPE by DuckDB recursive queries, partition by partition.

A partition's texts are cut by the vocabulary's pattern. Its distinct pieces go to an in-process
DuckDB as token-position rows: a recursive query joins every adjacent pair with the merge table and
contracts the leftmost pair of minimum rank of each piece, until no pair is left; an ordered
aggregation of the vocabulary's bytes decodes the resulting ids. Texts are then put together from
their pieces with numpy. Nothing is shuffled, and memory holds one batch of texts plus a bounded
dictionary of pieces.

A piece longer than ``CHUNK`` bytes is cut into overlapping chunks, which are encoded alike and joined at a
boundary that both have, where the two tokens that meet there, taken as a text, encode to themselves:
ids are the encoding of a text exactly if that holds for each two neighbours, so the joined ids are
those of the whole piece. Chunks that have no such boundary are encoded as one. The work of a long piece
so grows with its length, not with its square.

A null text counts as empty: no ids, no bytes. Repeated rows are encoded row by row. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import cache

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import strings, table

#: Pieces the dictionary holds before it is emptied, pieces per DuckDB query, texts per output batch.
KEPT, AT_ONCE, ROWS = 600_000, 40_000, 1000
#: Characters of pieces that the dictionary holds; bytes of a chunk, and of its overlap with the next.
HELD, CHUNK, OVERLAP = 64_000_000, 512, 64

#: Token-position rows (a list's index is the position) join the merge table; the leftmost pair of
#: minimum rank of each piece is contracted. A merged token's id is its rank. A piece without such a
#: pair has reached its fixpoint and is live no more.
ENCODE = """
WITH RECURSIVE state(piece, ids, live) AS (
    SELECT piece, ids, true FROM todo
    UNION ALL
    SELECT piece, CASE WHEN best IS NULL THEN ids ELSE ids[:(best & 1099511627775) - 1] || [(best >> 40)::INT] || ids[(best & 1099511627775) + 2:] END, best IS NOT NULL
    FROM (SELECT piece, ids FROM state WHERE live) LEFT JOIN (
        SELECT piece, min((m.merged::BIGINT << 40) | pos) AS best
        FROM (SELECT piece, ids, unnest(range(1, len(ids))) AS pos FROM state WHERE live) AS token
        JOIN merges AS m ON m.pair = ((ids[pos]::BIGINT << 32) | ids[pos + 1])
        GROUP BY piece
    ) USING (piece)
)
SELECT piece, ids FROM state WHERE NOT live ORDER BY piece
"""
#: Ordered aggregation decodes: the bytes (as hex) of a piece's ids, in order.
DECODE = """
SELECT piece, coalesce(string_agg(v.hex, '' ORDER BY pos), '') AS hex
FROM (SELECT piece, unnest(ids) AS id, unnest(range(len(ids))) AS pos FROM encoded) AS token
JOIN vocabulary AS v USING (id) GROUP BY piece ORDER BY piece
"""


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Engine:
    """The merge and vocabulary tables in DuckDB, and the dictionary of pieces seen so far."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall
        known = ranks(path)
        self.byte = [known[bytes([b])] for b in range(256)]
        pairs, merged = [], []
        for token, rank in known.items():
            for cut in range(1, len(token)):
                a, b = known.get(token[:cut]), known.get(token[cut:])
                if a is not None and b is not None:
                    pairs.append((a << 32) | b)
                    merged.append(rank)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self._table("merges", pa.table({"pair": pa.array(pairs, pa.int64()), "merged": pa.array(merged, pa.int32())}))
        self._table("vocabulary", pa.table({"id": pa.array(list(known.values()), pa.int32()), "hex": [t.hex() for t in known]}))
        self.token = {rank: token for token, rank in known.items()}
        self._clear()

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _clear(self) -> None:
        self.place: dict[str, int] = {}
        self.held = 0
        self.n_ids, self.n_bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids, self.data = np.zeros(0, np.int32), np.zeros(0, np.uint8)

    def _contracted(self, raw: list[bytes]) -> pa.ListArray:
        """The ids of each byte string, by the recursive query."""
        parts, start, size = [], 0, 0
        for i, r in enumerate(raw):
            size += 40 + len(r)
            if size > 50 * AT_ONCE or i + 1 == len(raw):
                parts.append(raw[start : i + 1])
                start, size = i + 1, 0
        found = [pa.array([], pa.list_(pa.int32()))]
        for part in parts:
            at = np.zeros(len(part) + 1, np.int32)
            np.cumsum([len(r) for r in part], out=at[1:])
            flat = np.array(self.byte, np.int32)[np.frombuffer(b"".join(part), np.uint8)]
            self.db.register("todo", pa.table({"piece": pa.array(range(len(part)), pa.int32()), "ids": pa.ListArray.from_arrays(at, flat)}))
            found.append(self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks())
            self.db.unregister("todo")
        return pa.concat_arrays(found)

    def _joined(self, raw: bytes) -> list[int]:
        """The ids of a long piece, from those of its chunks."""
        starts = list(range(0, len(raw), CHUNK))
        while True:
            chunks = [raw[s : e + OVERLAP] for s, e in zip(starts, [*starts[1:], len(raw)], strict=True)]
            ids = self._contracted(chunks).to_pylist()
            ends = [s + np.cumsum([len(self.token[i]) for i in own]) for s, own in zip(starts, ids, strict=True)]
            meets = []
            for k, s in enumerate(starts[1:]):
                common = np.intersect1d(ends[k], ends[k + 1][:-1])
                i, j = np.searchsorted(ends[k], common), np.searchsorted(ends[k + 1], common) + 1
                meets.append([(int(a), int(b), (ids[k][a], ids[k + 1][b])) for a, b in zip(i, j, strict=True)])
            pairs = sorted({m[2] for own in meets for m in own})
            sound = {p for p, got in zip(pairs, self._contracted([self.token[a] + self.token[b] for a, b in pairs]).to_pylist(), strict=True) if got == list(p)}
            chosen = [next((m for m in own if m[2] in sound), None) for own in meets]
            if all(chosen):
                begin = [0, *[m[1] for m in chosen]]
                stop = [*[m[0] + 1 for m in chosen], len(ids[-1])]
                return [i for own, a, b in zip(ids, begin, stop, strict=True) for i in own[a:b]]
            starts = [starts[0], *[s for s, m in zip(starts[1:], chosen, strict=True) if m]]

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces that are not in the dictionary yet."""
        if not pieces:
            return
        raw = [p.encode() for p in pieces]
        lists = self._contracted([r if len(r) <= CHUNK else b"" for r in raw])
        if any(long := [len(r) > CHUNK for r in raw]):
            coded = [self._joined(r) if far else own for r, far, own in zip(raw, long, lists.to_pylist(), strict=True)]
            lists = pa.array(coded, pa.list_(pa.int32()))
        back: list[bytes] = []
        for at in range(0, len(raw), AT_ONCE):
            part = lists.slice(at, AT_ONCE)
            self.db.register("encoded", pa.table({"piece": pa.array(range(len(part)), pa.int32()), "ids": part}))
            back += [bytes.fromhex(x) for x in self.db.sql(DECODE).to_arrow_table().column("hex").to_pylist()]
            self.db.unregister("encoded")
        base = len(self.place)
        self.place.update(zip(pieces, range(base, base + len(pieces)), strict=True))
        self.held += sum(map(len, raw))
        self.n_ids = np.concatenate([self.n_ids, lists.value_lengths().to_numpy().astype(np.int64)])
        self.ids = np.concatenate([self.ids, lists.flatten().to_numpy().astype(np.int32)])
        self.n_bytes = np.concatenate([self.n_bytes, np.array([len(b) for b in back], np.int64)])
        self.data = np.concatenate([self.data, np.frombuffer(b"".join(back), np.uint8)])

    def round_trip(self, texts: list[str]) -> tuple[pa.Array, pa.Array]:
        """The ids of each text, and the bytes that its ids stand for."""
        pieces = [self.find(t) for t in texts]
        new = {p for own in pieces for p in own}
        if len(self.place) + len(new) > KEPT or self.held > HELD:
            self._clear()
        self.learn(sorted(new.difference(self.place)))
        n = np.array([len(p) for p in pieces], np.int64)
        index = np.fromiter((self.place[p] for own in pieces for p in own), np.int64, int(n.sum()))
        first = np.concatenate([[0], np.cumsum(n)])
        out = []
        for lengths, values in ((self.n_ids, self.ids), (self.n_bytes, self.data)):
            start = np.concatenate([[0], np.cumsum(lengths)])[:-1]
            size = lengths[index]
            end = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(start[index] - end[:-1], size) + np.arange(end[-1])
            out.append((end[first].astype(np.int32), values[take] if len(take) else values[:0]))
        (id_at, ids), (byte_at, data) = out
        binary = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(byte_at), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.ListArray.from_arrays(pa.array(id_at), pa.array(ids)), binary


_engines: dict[tuple[str, str], Engine] = {}


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Replace ``text`` by ``ids`` (array of int) and ``decoded`` (binary, from the ids alone).
    Input columns named ids or decoded are replaced."""
    held = [c for c in df.columns if c not in (text, "ids", "decoded")]
    source = df.select(*[F.col(f"`{c}`") for c in held], F.col(f"`{text}`").alias(text))
    schema = T.StructType([source.schema[c] for c in held] + [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        engine = _engines.get((path, pattern)) or _engines.setdefault((path, pattern), Engine(path, pattern))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                ids, data = engine.round_trip(strings(b.column(len(held))).to_pylist())
                yield pa.RecordBatch.from_arrays([*b.columns[: len(held)], ids, data], names=[f.name for f in schema])

    return source.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
