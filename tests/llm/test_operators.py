"""The ten operators against brute force, exact round trips and edge cases: nulls, empty and long texts,
ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tessera.llm")

from tessera.llm import bpe, chat, common, graph, jaccard, langid, packing, passages, quality, topk, toxicity, warc
from tessera.llm import textkernel as K

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "a\n\na\n b", "x y z x y z", "ÀÉ ß ü 漢字 😀 ok", "#*$%&|<> !", "the end " * 40_000, "<|endoftext|> it's  1234\r\n\r\n  x"]


def save(spark, folder, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def documents(texts, langs=("en",)):
    return [(i, t, langs[i % len(langs)], "s", len(t) if t is not None else None) for i, t in enumerate(texts)], DOCS


def invented(rng, syllables, n):
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(n))


SYLLABLES = {"en": ["th", "er", "ing", "on", "and"], "de": ["sch", "ein", "ung", "ü", "ich"], "fr": ["eau", "è", "oi", "que", "ç"]}


# --- text kernel ----------------------------------------------------------------------------------


def test_kernel_hashes_are_by_content():
    import pyarrow as pa

    texts = ["ab cd ab", "cd", "", "ab\ncd"]
    seen = {}
    for t in K.runs(pa.array(texts), limit=4):
        s, e, own = t.spans(~K.SPACE[t.data])
        for h, i, j, o in zip(K.hashes(t.prefix(), s, e), s, e, own, strict=True):
            word = bytes(t.data[i:j])
            assert seen.setdefault(word, h) == h and word.decode() in texts[t.first + o]
    assert len(seen) == 2 and len(set(seen.values())) == 2


# --- 9: quality rules -----------------------------------------------------------------------------


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    count = collections.Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_quality_base_columns(spark, tmp_path):
    rng = random.Random(1)
    texts = ODD + ["\n".join(rng.choice(["a b", "c  d", "", " "]) for _ in range(rng.randint(0, 30))) for _ in range(80)]
    d = save(spark, tmp_path, documents=documents(texts))
    rows = quality.query(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r)[1:6] == brute_quality(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_quality_model_against_labels(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    judged = quality.query(spark, sf_dir).filter("not base_failed").join(labels, "doc_id").groupBy("truth", "kept").count().collect()
    by = {(r["truth"], r["kept"]): r["count"] for r in judged}
    assert by.get((1, True), 0) > 20 * by.get((1, False), 0)
    assert by.get((0, True), 0) <= by.get((0, False), 0)


def brute_em(rows, rounds=500):
    """EM over documents, one by one: P(good) of each."""
    good = [0.25 if -1 in r else 0.9 for r in rows]
    for _ in range(rounds):
        prior = min(0.98, max(0.02, sum(good) / len(rows)))
        weight = [[1 - g for g in good], good]
        p = [[(sum(w for w, r in zip(c, rows) if r[k] == -1) + 1) / (sum(w for w, r in zip(c, rows) if r[k]) + 2) for k in range(len(rows[0]))] for c in weight]
        new = []
        for r in rows:
            like = [1 - prior, prior]
            for c in (0, 1):
                for k, v in enumerate(r):
                    like[c] *= p[c][k] if v == -1 else 1 - p[c][k] if v == 1 else 1
            new.append(like[1] / (like[0] + like[1]))
        moved = max(abs(a - b) for a, b in zip(new, good))
        good = new
        if moved < 1e-9:
            break
    return good


def test_label_model_equals_em_over_documents():
    rng = np.random.default_rng(0)
    y = rng.random(400) < 0.8
    votes = np.stack([np.where(rng.random(len(y)) < 0.2, 0, np.where(rng.random(len(y)) < p, np.where(y, 1, -1), np.where(y, -1, 1))) for p in (0.95, 0.9, 0.8, 0.9, 0.85)], axis=1)
    patterns, of, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    model = quality.fit(patterns, counts)
    assert np.allclose(model.posterior(patterns)[of], brute_em(votes.tolist()), atol=1e-6)
    assert ((model.posterior(votes) >= 0.5) == y).mean() > 0.95 and (model.accuracies() > 0.6).all()


def test_label_model_weighs_votes():
    """Three rules that agree on bad documents outweigh; a rule that fails alone is learned as noise."""
    rows = [[1, 1, 1, 1]] * 900 + [[-1, -1, -1, 1]] * 80 + [[1, 1, 1, -1]] * 60 + [[-1, -1, 0, 0]] * 5
    patterns, counts = np.unique(np.array(rows), axis=0, return_counts=True)
    kept = {tuple(p): g >= 0.5 for p, g in zip(patterns.tolist(), quality.fit(patterns, counts).posterior(patterns), strict=True)}
    assert kept == {(1, 1, 1, 1): True, (-1, -1, -1, 1): False, (1, 1, 1, -1): True, (-1, -1, 0, 0): False}


def test_quality_verdict_is_not_all_must_pass(spark):
    """On the tables of sf0.01, some documents with a bad vote are kept; the verdict is the brute-force EM's."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    features = quality.with_features(docs)
    rows = features.select("doc_id", *[r.vote().alias(f"v{i}") for i, r in enumerate(quality.RULES)], F.expr(quality.BASE_FAILED).alias("base")).orderBy("doc_id").collect()
    votes = [list(r)[1:-1] for r in rows]
    want = {r["doc_id"]: not r["base"] and g >= 0.5 for r, g in zip(rows, brute_em(votes), strict=True)}
    assert {r["doc_id"]: r["kept"] for r in quality.judge(features).collect()} == want
    assert any(want[r["doc_id"]] for r, v in zip(rows, votes, strict=True) if -1 in v)
    assert not all(want[r["doc_id"]] for r, v in zip(rows, votes, strict=True) if not r["base"])


def test_quality_stage_and_clashing_columns(spark, tmp_path):
    rng = random.Random(2)
    texts = [invented(rng, SYLLABLES["en"], 120) for _ in range(60)] + [None, "", "short", "x " * 200]
    df = spark.createDataFrame(*documents(texts)).withColumn("n_words", F.lit("mine")).withColumn("kept", F.lit(1))
    out = quality.stage(spark, df, "")
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == list(range(60))
    assert quality.query(spark, save(spark, tmp_path, documents=([], DOCS))).count() == 0


# --- 1: language ----------------------------------------------------------------------------------


def test_language_held_out(spark, tmp_path):
    rng = random.Random(3)
    langs = list(SYLLABLES)
    rows = [(i, invented(rng, SYLLABLES[langs[i % 3]], rng.randint(5, 80)), langs[i % 3], "s", 0) for i in range(400)]
    rows += [(1000 + i, t, None, "s", 0) for i, t in enumerate(ODD)]
    d = save(spark, tmp_path, documents=(rows, DOCS))
    out = {r["doc_id"]: r for r in langid.query(spark, d).collect()}
    assert len(out) == len(rows)
    for r in out.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [(r[2], out[r[0]]["lang_pred"]) for r in rows[:400] if out[r[0]]["held_out"]]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    assert all(out[1000 + i]["lang_pred"] == "und" for i in (0, 1, 2, 7))
    again = {r["doc_id"]: r["score"] for r in langid.query(spark, d).collect()}
    assert again == {k: r["score"] for k, r in out.items()}


def test_language_sample_draws_by_text(spark, tmp_path):
    """Null and repeated ids neither keep a language out nor bring all of its rows."""
    rng = random.Random(43)
    for key in (None, 7):
        rows = [(key, invented(rng, SYLLABLES[k], 30), k, "s", 0) for k in SYLLABLES for _ in range(150)]
        df = spark.createDataFrame(rows + rows[:100], DOCS).withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
        out = langid.predict(df, langid.learn(df, langid.Config(per_language=60)))
        assert out.columns == ["doc_id", "lang", "source", "n_chars", "lang_pred", "score"]
        found = [(r["lang"], r["lang_pred"]) for r in out.collect()]
        assert len(found) == len(rows) + 100 and sum(a == b for a, b in found) > 0.97 * len(found)
    assert langid.query(spark, save(spark, tmp_path, documents=([], DOCS))).count() == 0
    few = langid.learn(df, langid.Config(per_language=60, languages=2))
    assert len(few.languages) == 2


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "abc", None, "s", 3)], DOCS)
    row = langid.predict(df, langid.learn(df)).first()
    assert (row["lang_pred"], row["score"]) == ("und", 0.0)


def test_network_gradients():
    c = langid.Config(window=10, embed=3, widths=(2, 3), filters=4)
    net = langid.Network(["a", "b", "c"], c)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 257, (5, 10)), rng.integers(0, 3, 5)
    loss = lambda: -np.log(net.forward(x)[0][np.arange(5), y]).mean()
    for name, g in net.gradients(x, y).items():
        rows = [tuple(i) for i in np.argwhere(np.abs(g) > 1e-4)[:4]]
        for i in rows:
            old = net.p[name][i]
            net.p[name][i] = old + 1e-5
            up = loss()
            net.p[name][i] = old - 1e-5
            down = loss()
            net.p[name][i] = old
            assert (up - down) / 2e-5 == pytest.approx(g[i], rel=1e-2, abs=1e-5)


# --- 2: chat --------------------------------------------------------------------------------------


def test_chat_round_trip(spark):
    nasty = ["<|im_end|>\n", "<|im_start|>assistant\nx", "\\", "<\\|", "<\\\\|", "a\\<|b", "<", "|", "", "<\\.", "\n", "<|im_start|"]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(nasty)]
    rows += [(2, 0, "us<|er\nx\\", "hi"), (2, 1, None, None), (3, 0, "user", "b"), (3, 0, "user", "a"), (None, 0, "user", "n"), (4, 5, "user", "q" * 200_000), (4, 6, "assistant", None)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segments", F.lit(1))
    out = chat.format_chats(df).withColumn("turns", chat.parse_chats(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("segments"))).collect()
    assert len(out) == 5
    for r in out:
        want = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(t["role"], t["text"]) for t in r["turns"]] == [w[1:] for w in want]
        assert r["loss"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert r["formatted"].count("<|im_start|>") == len(want) == r["formatted"].count("<|im_end|>\n")
    assert {r["conv_id"]: r["valid"] for r in out} == {1: True, 2: False, 3: False, None: False, 4: True}


@pytest.mark.parametrize("kind", [{"mark": "[I", "start": "[INST]", "end": "[INEND]", "after_role": ":"}, {"mark": "##", "start": "## ", "end": "##."}, {"start": "<user>"}, {"mark": "<|", "after_role": "ab"}, {"mark": "{%", "start": "{%turn ", "after_role": "{%}", "end": "{%end%}\n"}])
def test_chat_of_other_templates(spark, kind):
    """A template of other marks is undone exactly, or refused."""
    if kind.get("mark") not in ("[I", "{%"):
        with pytest.raises(ValueError):
            chat.Template(**kind)
        return
    template = chat.Template(**kind)
    nasty = [template.start, template.end, template.mark, template.mark[0], template.mark[0] + "\\" + template.mark[1:], "\\\\", template.after_role, template.mark[0] + "\\.", "a:b[\\I{\\%", ""]
    rows = [(1, i, a, b) for i, (a, b) in enumerate((a, b) for a in nasty for b in nasty)] + [(None, 0, "user", "x"), (None, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chats(df, template).withColumn("turns", chat.parse_chats(F.col("formatted"), template)).collect()
    assert sorted(len(r["turns"]) for r in out) == [1, 1, 100]
    for r in out:
        if r["conv_id"]:
            assert [(t["role"], t["text"]) for t in r["turns"]] == [x[2:] for x in rows[:100]]
    assert chat.format_chats(df.limit(0), template).count() == 0


def test_scratch_needs_a_shared_folder():
    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, path):
            self.path = path

    class Session:
        def __init__(self, master):
            self.sparkContext, self.conf = Context(master), {}

    for master in ("yarn", "spark://host:7077", "local-cluster[3,2,1024]", "k8s://https://x"):
        with pytest.raises(ValueError, match="share"):
            common.scratch_root(Session(master))
    assert common.scratch_root(Session("local[4]")).startswith("file://")


def test_chat_query_is_native(spark, sf_dir):
    plan = chat.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|MapIn", plan)


# --- 3: toxicity ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark, tmp_path):
    rng = random.Random(4)
    bad = ["vile", "scoundrel", "cretin"]
    texts, labels = [], []
    for i in range(900):
        words = invented(rng, SYLLABLES["en"], rng.randint(20, 200)).split()
        toxic = i % 6 == 0
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        texts.append(" ".join(words))
        labels.append((i, 1, int(toxic)))
    d = save(spark, tmp_path, documents=documents(texts + ODD), labels=(labels, "doc_id long, quality int, toxic int"))
    out = {r["doc_id"]: r for r in toxicity.query(spark, d).collect()}
    assert len(out) == len(texts) + len(ODD)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in out.items())
    held = [(t, out[i]["predicted"]) for i, _, t in labels if out[i]["held_out"]]
    assert sum(a == b for a, b in held) > 0.97 * len(held)
    assert sum(p for t, p in held if t) > 0.9 * sum(t for t, _ in held)


def brute_kneser_ney(texts, labels, given):
    """log p of a word after another, or after none, in each class; plain dictionaries."""
    n2 = {c: collections.Counter(p for t in {t for t, y in zip(texts, labels, strict=True) if y == c} for p in set(zip(t, t[1:], strict=False))) for c in (1, 0)}
    left_over = lambda a, b: {k: given[min(a.get(k, 0), 3)] + given[min(b.get(k, 0), 3)] for k in {*a, *b}}
    both = left_over(n2[1], n2[0])
    vocabulary = {w for t in texts for w in t}
    cont = {c: collections.Counter(w for _, w in n) for c, n in n2.items()}
    cont["both"] = left_over(cont[1], cont[0])
    spread = collections.Counter(min(v, 5) for v in cont["both"].values()), collections.Counter(min(v, 5) for v in both.values())

    def modified(n):
        if not all(n[k] for k in range(1, 5)):
            return [0, 0.75, 1.5, 2.25]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *[min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3)]]

    def level(counts, w, d, lower):
        total = sum(counts.values())
        if not total:
            return lower
        n = counts.get(w, 0)
        return (n - d[min(int(n), 3)]) / total + sum(d[min(int(v), 3)] for v in counts.values()) / total * lower

    def log(c, before, w):
        word = level(cont[c], w, given, level(cont["both"], w, modified(spread[0]), 1 / (len(vocabulary) + 1)))
        if before is None:
            return np.log(word)
        after = lambda n: {b: k for (a, b), k in n.items() if a == before}
        return np.log(level(after(n2[c]), w, given, level(after(both), w, modified(spread[1]), word)))

    return log


def test_toxicity_model_is_kneser_ney():
    import pyarrow as pa

    rng = random.Random(40)
    words = [f"w{i}" for i in range(30)]
    texts = [tuple(rng.choice(words[: 8 + i % 22]) for _ in range(rng.randint(1, 30))) for i in range(60)]
    texts += texts[:5]
    labels = [i % 3 == 0 for i in range(60)] + [i % 3 == 0 for i in range(5)]
    named = sorted(set(texts))
    (t,) = K.lowered_runs(pa.array([" ".join(x) for x in texts]))
    h, own = toxicity.tokens(t)
    text_of = np.array([named.index(x) for x in texts])
    model = toxicity.train(h, text_of[own], np.array(labels)[own], toxicity.Config())
    log = brute_kneser_ney(texts, [int(y) for y in labels], [0, 1, 2, 3])
    probe = ["w1", "new", "w3", "w29", "w2", "w1", "w1", "other", "w25"]
    (t,) = K.lowered_runs(pa.array([" ".join(probe)]))
    got = model.logs(*toxicity.tokens(t))
    for i, w in enumerate(probe):
        before = probe[i - 1] if i else None
        assert got[:, i] == pytest.approx([log(c, before, w) for c in (1, 0)], rel=1e-5)
    ratio = got[0] - got[1]
    x = toxicity.features(model, *toxicity.tokens(t), 1, 3)[0]
    assert x == pytest.approx([ratio.mean(), max(ratio[i : i + 3].mean() for i in range(len(probe) - 2))])
    for known in ("w1", "w20"):  # probabilities add up to one
        (t,) = K.lowered_runs(pa.array([f"{known} {w}" for w in [*sorted({w for x in texts for w in x}), "unheard"]]))
        p = np.exp(model.logs(*toxicity.tokens(t))[:, 1::2]).sum(axis=1)
        assert p == pytest.approx([1, 1], rel=1e-4)


def test_toxicity_of_real_tables(spark):
    """Both length-normalised ratios count for toxicity, and held-out texts are told apart."""
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    seen = labels.filter(common.hashed_id(F.col("doc_id")) % 4 != 2)
    model = toxicity.learn(spark.read.parquet(f"{d}/documents.parquet"), seen)
    assert (model.curve[:2] >= 0).all() and model.curve[:2].sum() > 1


def test_toxicity_repeated_ids(spark, tmp_path):
    """One id on many rows brings no more texts to the driver than the sample's bound; names may clash."""
    docs = spark.range(3000).select(F.lit(1).alias("doc_id"), F.concat(F.lit("text number w"), "id").alias("text")).unionByName(spark.createDataFrame([(2, "vile scoundrel"), (2, "vile scoundrel")], "doc_id int, text string"))
    labels = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "doc_id int, toxic int")
    model = toxicity.learn(docs, labels, toxicity.Config(per_class=50))
    assert len(model.ratios.words) < 250
    out = toxicity.score(docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit("y")), model)
    assert out.columns == ["doc_id", "score", "predicted"] and out.count() == 3002
    empty = save(spark, tmp_path, documents=([], DOCS), labels=([], "doc_id long, quality int, toxic int"))
    assert toxicity.query(spark, empty).count() == 0


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (1, 1, 0)], [(0, 1, 1)], [(0, 1, None), (None, 1, 1)]])
def test_toxicity_without_both_classes(spark, tmp_path, labels):
    d = save(spark, tmp_path, documents=documents(["a b", None, "c"]), labels=(labels, "doc_id long, quality int, toxic int"))
    assert len({r["score"] for r in toxicity.query(spark, d).collect()}) == 1


# --- 4: packing -----------------------------------------------------------------------------------


def test_packing_keeps_every_token(spark, tmp_path):
    import public_tokenizers as p
    from tokenizers import Tokenizer

    rng = random.Random(5)
    texts = ODD + [invented(rng, SYLLABLES[k], rng.randint(1, 900)) for k in SYLLABLES for _ in range(20)] + ["same text"] * 3
    rows, schema = documents(texts)
    d = save(spark, tmp_path, documents=(rows, schema))
    out = packing.query(spark, d).collect()
    full = Tokenizer.from_file(p.path("byte_bpe_50k.json"))
    by = collections.defaultdict(list)
    for r in out:
        by[r["doc_id"]].append(r)
    assert len(by) == len(texts)
    for i, t in enumerate(texts):
        ids, at = np.array([*full.encode(t or "", add_special_tokens=False).ids, 0], "<u4"), 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    sequences = collections.defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # full windows and powers of two: no padding at all
    assert packing.query(spark, save(spark, tmp_path / "e", documents=([], DOCS))).count() == 0


def test_packing_index_is_bm25_over_all_documents():
    rng = np.random.default_rng(0)
    topics = [rng.choice(np.arange(t * 500, t * 500 + 400), int(rng.integers(200, 400))).astype(np.uint32) for t in (0, 1) for _ in range(30)]
    shard = topics[:20] + topics[30:40]
    n, mean = len(topics), np.mean([len(t) for t in topics])
    df = np.bincount(np.concatenate([np.unique(t) for t in topics]), minlength=1000)
    counts = packing.Counts(df, n, mean)
    tails = [packing.Tail(i, 0, t, len(t), *np.unique(t, return_counts=True)) for i, t in enumerate(shard)]
    s = packing.Index(tails, counts, packing.Config()).scores(0)
    want = np.zeros(len(shard))
    for t in np.unique(shard[0]):
        idf = np.log((n - df[t] + 0.5) / (df[t] + 0.5))
        if idf > 0:
            for j, d in enumerate(shard):
                tf = (d == t).sum()
                want[j] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean)) if tf else 0
    assert np.allclose(s, want) and s[1:20].min() > s[20:].max()


def test_packing_brings_neighbours_together(spark):
    """Documents of 300 subjects, shuffled over the whole table, share windows with their own subject far
    more often than documents in the order of the table would, or by chance."""
    rng = random.Random(47)
    subjects = [[invented(rng, SYLLABLES["en"], 1) + str(1000 + s * 40 + i) for i in range(20)] for s in range(300)]
    rows = [(i, i % 300, " ".join(rng.choice(subjects[i % 300]) for _ in range(40))) for i in range(1500)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, text string").repartition(4)
    subject = {i: s for i, s, _ in rows}
    together = collections.defaultdict(set)
    for r in packing.packed(df).collect():
        together[r["sequence_id"]].add(r["doc_id"])
    pairs = [(a, b) for own in together.values() for a in own for b in own if a < b]
    share = sum(subject[a] == subject[b] for a, b in pairs) / len(pairs)
    assert share > 0.15  # by chance: 1 in 300; subjects share numerals, and have five documents to a window of six


def test_packing_of_odd_tables(spark):
    df = spark.createDataFrame([("k", None, 1), ("k", "a b", 2), (None, "a b", 3), ("x", "long text " * 30_000, 4)] + [("k", "a b", 2)] * 40, "doc_id string, text string, start long")
    out = packing.packed(df)
    assert out.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    pieces = out.collect()
    assert {r["doc_id"] for r in pieces} == {"k", "x", None} and sum(r["length"] for r in pieces if r["doc_id"] == "k") == 1 + 41 * 3
    assert len({(r["sequence_id"], r["offset"]) for r in pieces}) == len(pieces)
    assert packing.packed(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="column of the result"):
        packing.pack(df, "", "", "", key="start")


# --- 5: WARC --------------------------------------------------------------------------------------


def test_warc_query(spark, tmp_path):
    long = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/ä b", long), (1, None, long), (2, "u", "short"), (4, "u", "short"), (5, "u\r\nX: y", None), (6, "u", long + "z"), (6, "u", long + "z"), (None, "u", long), (7, "u", "\r\n\r\n" * 60), (8, "", "é" * 300_000)]
    d = save(spark, tmp_path, pages=(rows, "page_id long, url string, html string"))
    out = sorted(map(tuple, warc.query(spark, d).collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        first = min(same)
        revisit = len(raw) >= 100 and first != i
        want.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert out == sorted(want, key=str)
    assert warc.query(spark, save(spark, tmp_path / "e", pages=([], "page_id long, url string, html string"))).count() == 0


def test_warc_repeated_task_is_read_once(spark, tmp_path):
    """Files of an attempt that was not committed stay in the folder, and are not read."""
    df = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(50)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    lost = warc.write_archives(warc.mark_revisits(df), folder)
    kept = warc.write_archives(warc.mark_revisits(df), folder)
    assert sorted(r["page_id"] for r in warc.read_manifest(kept, folder).collect()) == list(range(50))
    assert warc.read_archives(spark, folder).count() == 100 and lost.count() == kept.count()
    wrong = kept.withColumn("records", F.col("records") + 1)
    with pytest.raises(Exception, match="differs from its manifest"):
        warc.read_manifest(wrong, folder).collect()


def test_warc_reader_rejects_damage():
    body = b"hello world" * 30
    records = [warc.record(i, "http://x/", body + bytes([65 + i % 26]) * i, hashlib.sha256(body + bytes([65 + i % 26]) * i).hexdigest(), len(body) + i, None) for i in range(200)]
    data = warc.build_archive(records)
    assert struct.unpack_from("<I", data)[0] == warc.DICTIONARY_MAGIC
    assert list(warc.read_records(data)) == records and warc.parse(records[5])[6] == body + b"F" * 5
    assert list(warc.read_records(warc.build_archive(records[:1]))) == records[:1]
    for broken in (data[:-3], data[4:], b"", data[:6], data[:20]):
        with pytest.raises(ValueError):
            list(warc.read_records(broken))
    with pytest.raises(ValueError):
        flipped = bytearray(data)
        flipped[-20] ^= 0xFF
        [warc.parse(r) for r in warc.read_records(bytes(flipped))]
    for header in (b"WARC-Type", b"WARC-Record-ID", b"WARC-Target-URI", b"WARC-Payload-Digest", b"WARC-Block-Digest", b"Content-Length"):
        with pytest.raises(ValueError, match="missing"):
            warc.parse(re.sub(rb"\r\n" + header + rb": [^\r]*", b"", records[3], count=1))
    for wrong in (records[3].replace(b"Content-Length: 333", b"Content-Length: 332", 1), records[3][:-2], records[3].replace(b"hello", b"jello", 1), b"x" + records[3]):
        with pytest.raises(ValueError):
            warc.parse(wrong)


# --- 7: BPE ---------------------------------------------------------------------------------------


def test_bpe_equals_tiktoken(spark, tmp_path):
    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    rng = random.Random(6)
    texts = ODD + ["".join(rng.choice("ab é1'_\n漢😀st") for _ in range(rng.randint(1, 60))) for _ in range(150)] + ["zq" * 3000]
    d = save(spark, tmp_path, documents=documents(texts))
    rows = bpe.query(spark, d).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]] or ""
        ids = enc.encode_ordinary(t)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()


def test_bpe_of_long_pieces():
    """Pieces of up to a million bytes are joined from chunks, in time that grows with their length."""
    import time

    import public_tokenizers as p
    import tiktoken

    path = p.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("t", pat_str=p.PATTERN, mergeable_ranks=bpe.ranks(path), special_tokens={})
    engine = bpe.Engine(path, p.PATTERN)
    rng = random.Random(42)
    tokens = [t.decode() for t in bpe.ranks(path) if t.isalpha() and t.isascii()]
    long = ["a" * 5000, "ab" * 3000, "=" * 4097, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "".join(rng.choice(tokens) for _ in range(4000)), "漢字" * 900, "é" * 513, "".join(rng.choice("aeno") for _ in range(9000)), "x" * 512, "x" * 513]
    for text, ids in zip(long, engine.round_trip(long)[0].to_pylist(), strict=True):
        assert ids == enc.encode_ordinary(text)
    began = time.time()
    huge = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    ids, data = engine.round_trip([huge])
    assert data.to_pylist() == [huge.encode()] and time.time() - began < 60
    for k in range(0, 1_000_000, 100_000):  # without its bounds, a slice of the whole is the encoding of what it spans
        part = ids.to_pylist()[0][k // 4 : k // 4 + 500]
        assert enc.encode_ordinary(b"".join(engine.token[i] for i in part).decode()) == part


def test_bpe_edge_tables(spark, tmp_path):
    assert bpe.query(spark, save(spark, tmp_path, documents=([], DOCS))).count() == 0
    import public_tokenizers as p

    df = spark.createDataFrame([("a", "x", "hello")], "ids string, decoded string, text string")
    out = bpe.encode_decode(df, p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    assert out.columns == ["ids", "decoded"] and bytes(out.first()["decoded"]) == b"hello"


def test_bpe_dictionary_may_overflow(monkeypatch):
    import public_tokenizers as p

    monkeypatch.setattr(bpe, "KEPT", 3)
    engine = bpe.Engine(p.path("byte_bpe_50k.tiktoken"), p.PATTERN)
    for t in (["one two three four"], ["five six", "", "one"]):
        assert [b.decode() for b in engine.round_trip(t)[1].to_pylist()] == t


# --- 8: top-k -------------------------------------------------------------------------------------


def test_topk_equals_brute_force(spark, tmp_path):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(0, 0.2, 8).astype(np.float32).tolist()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]  # one vector repeated: ties
    rows += [(2000, None), (2001, [0.1, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] * 8), (None, [0.1] * 8), (2100, [0.25] * 3), rows[0], rows[7], rows[7], rows[7], (2004, [])]
    d = save(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    assert topk_rows(topk.query(spark, d)) == brute_topk(rows)


def topk_rows(df):
    out = collections.defaultdict(list)
    for r in df.collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    return {q: sorted(x) for q, x in out.items()}


def brute_topk(rows):
    """All rows are candidates, repeated ones too; equal query rows are one query."""
    hold = lambda x, bound: max(-bound, min(bound, x))
    sound = [(i, tuple(hold(int(np.floor(1024 * float(np.float32(x)))), 1 << 62) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, a in {(i, v) for i, v in sound if i % 100 == 0}:
        s = sorted((-hold(sum(x * y for x, y in zip(a, v, strict=False)), (1 << 63) - 1), i) for i, v in sound if i != q)[:10]
        out[q] = [(k + 1, i, -x) for k, (x, i) in enumerate(s)]
    return out


def test_topk_of_large_components(spark, tmp_path):
    rng = np.random.default_rng(41)
    rows = [(i, (rng.normal(0, 1, 4) * scale).astype(np.float32).tolist()) for i, scale in enumerate([4e6, 1e3, 1.0, 3e9, 1e30, 4e6, 4e6, 1e12] * 30)]
    d = save(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    assert topk_rows(topk.query(spark, d)) == brute_topk(rows)


def test_topk_of_a_row_repeated_by_a_third(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("vec_id"), F.when(F.col("id") % 3 == 0, F.array(F.lit(9), F.lit(9))).otherwise(F.array(F.col("id") % 7, F.col("id") % 5)).alias("v"))
    index = topk.build(df.withColumn("row", F.monotonically_increasing_id()), topk.Config(block=64))[0]
    assert index.agg(F.max("n"), F.sum("n")).first()[:] == (64, 3000)
    out = topk_rows(topk.search(df, F.col("vec_id") == 100, topk.Config(block=64)))
    assert [x[1] for x in out[100]] == [5] * 10


@pytest.mark.parametrize("rows", [[], [(100, [1.0])], [(100, [1.0]), (7, [2.0])]])
def test_topk_of_few(spark, tmp_path, rows):
    d = save(spark, tmp_path, embeddings=(rows, "vec_id long, embedding array<float>"))
    assert topk.query(spark, d).count() == max(0, len(rows) - 1)


def test_topk_prunes_and_stays_exact(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 900, (6, 16))
    x = (centres[rng.integers(0, 6, 1500)] + rng.normal(0, 20, (1500, 16))).astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<long>")
    config = topk.Config(block=32, pivots=16, k=5)
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(df, F.col("vec_id") % 50 == 0, config).collect()}
    s = x @ x.T
    for q in range(0, 1500, 50):
        order = sorted((-int(s[q, i]), i) for i in range(1500) if i != q)[:5]
        assert [got[(q, k + 1)] for k in range(5)] == [(i, -v) for v, i in order]


# --- 10: Jaccard join -----------------------------------------------------------------------------


def brute_sets(texts, k=5):
    out = {}
    for t in texts:
        w = re.findall("[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
        out[t] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


@pytest.mark.parametrize(("bucket", "block"), [(256, 1024), (8, 8), (2, 16)])
def test_jaccard_equals_brute_force(spark, bucket, block):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(2000)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for _ in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    line = [rng.choice(vocabulary) for _ in range(14)]
    texts += [" ".join([rng.choice(vocabulary) for _ in range(12)] + line) for _ in range(80)]
    texts += [texts[0].upper(), texts[1].replace(" ", ", ")]
    texts += texts[:5] + ["a b", "a b", "", None, None, "one two three four five", "x " * 9000]
    rows = list(enumerate(texts)) + [(0, texts[0]), (None, "a b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tid", F.lit(1)).withColumn("mins", F.lit(2))
    out = jaccard.near_duplicates(df, jaccard.Config(bucket=bucket, block=block)).collect()
    assert len(out) == len(rows)
    sets = brute_sets({t for _, t in rows if t})
    names = sorted(sets)
    parent, links = {t: t for t in names}, collections.Counter()

    def find(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for i, a in enumerate(names):
        for b in names[:i]:
            both = len(sets[a] & sets[b])
            if both and both / (len(sets[a]) + len(sets[b]) - both) >= 0.8:
                links[a] += 1
                links[b] += 1
                parent[find(a)] = find(b)
    least = {}
    for i, t in rows:
        if t and i is not None:
            least[find(t)] = min(least.get(find(t), i), i)
    text_of = dict(enumerate(texts))
    for r in out:
        if r["doc_id"] is None:
            assert r["class_id"] is None
            continue
        t = text_of[r["doc_id"]]
        assert (r["class_id"], r["n_links"]) == ((least[find(t)], links[t]) if t else (r["doc_id"], 0))


def test_jaccard_stage_keeps_one(spark):
    long = " ".join(f"w{i}" for i in range(60))
    near = long.replace("w30", "v")
    rows = [(1, near), (2, long), (3, long), (1, near), (4, None), (5, None), (6, "other words here"), (None, long)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("gone", F.lit(1)).withColumn("_key", F.lit(2))
    out = jaccard.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == [1, 4, 5, 6, None]
    assert jaccard.near_duplicates(df.limit(0)).count() == 0


def test_paths_reach_the_recall():
    c = jaccard.Config()
    for level in (1, 2, 3):
        n = c.reach(level)
        miss = lambda n: sum(__import__("math").comb(n, i) * 0.8**i * 0.2 ** (n - i) for i in range(level))
        assert miss(n) <= 1 - c.recall < miss(n - 1)


def test_sketch_cut_follows_similarity():
    for similarity, functions in ((0.8, 32), (0.7, 40), (0.5, 64), (0.9, 32)):
        c = jaccard.Config(similarity=similarity, functions=functions)
        assert c.below(functions, c.agree) <= 1e-6 < c.below(functions, c.agree + 1)
    assert jaccard.Config().agree == 13
    with pytest.raises(ValueError, match="functions"):
        jaccard.Config(similarity=0.3)


def test_alike_texts_cost_rows_by_blocks(spark):
    """Members of a bucket of one-word variants are repeated for each pair of blocks, not of texts."""
    n = 1200
    words = [f"w{i}" for i in range(100)]
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit(" ".join(words[:50])), F.lit(" v"), F.col("id"), F.lit(" " + " ".join(words[50:]))).alias("text"))
    config = jaccard.Config(bucket=16, block=128)
    full = jaccard.sketch(df, config).select("tid", "mins")
    assert jaccard.buckets(full, config).count() < 4 * n * (2 * 16 + config.reach(1))
    out = jaccard.near_duplicates(df, config)
    assert out.groupBy("class_id", "n_links").count().collect() == [(0, n - 1, n)]


def test_components(spark):
    chain = [(f"{i:03d}", f"{i + 1:03d}") for i in range(400)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert got == {f"{i:03d}": "000" for i in range(401)} | {"x": "x", "y": "x"}


def test_sieve_is_exact_on_the_safe_side(spark):
    df = spark.range(2000).withColumn("k", F.when(F.col("id") > 5, F.col("id")))
    maybe, rest = common.sieve(df, "k", spark.range(100, 200).select(F.col("id").alias("w")))
    inside, outside = {r["k"] for r in maybe.collect()}, {r["k"] for r in rest.collect()}
    assert set(range(100, 200)) <= inside and len(inside) < 130 and maybe.count() + rest.count() == 2000 and not inside & outside - {None}


# --- 6: passages ----------------------------------------------------------------------------------


def test_passages_are_found(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(60)]
    fuzzy = [word() if i in (20, 41) else w for i, w in enumerate(passage)]
    fuzzy = fuzzy[:50] + [word()] + fuzzy[50:]
    make = lambda middle, a, b: " ".join([word() for _ in range(a)] + middle + [word() for _ in range(b)])
    texts = {1: make(passage, 30, 10), 2: make(passage, 0, 50), 3: make(fuzzy, 20, 20), 4: make([], 80, 80), 5: None, 6: "", 7: make(passage[:30], 40, 40), 8: make(passage + [word() for _ in range(20)] + passage, 3, 3)}
    df = spark.createDataFrame([*texts.items(), (2, texts[2]), (None, texts[1])], "doc_id long, text string")
    out = passages.passages(df).distinct().collect()
    assert {r["doc_id"] for r in out} == {2, 3, 8}
    split = {k: WORD.findall(t or "") for k, t in texts.items()}
    for r in out:
        a, b = split[r["doc_id"]][r["start"] : r["end"]], split[r["ref_doc_id"]][r["ref_start"] : r["ref_end"]]
        assert r["ref_doc_id"] < r["doc_id"] and len(a) >= 50 and len(b) >= 50 and r["similarity"] >= 0.8
        if r["similarity"] == 1:
            assert a == b
    two = [r for r in out if r["doc_id"] == 2]
    assert [(r["start"], r["end"]) for r in two] == [(0, 60)]
    assert len([r for r in out if r["doc_id"] == 8]) == 2


def test_passages_stage_cuts_later_copies(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = [word() for _ in range(70)]
    texts = [(1, " ".join([word(), *passage])), (2, "\n".join(["first line", " ".join(passage), "last  line"])), (3, "untouched  text\n"), (4, None), (5, " ".join(passage))]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], DOCS).withColumn("spans", F.lit(1))
    out = {r["doc_id"]: r for r in passages.stage(spark, df, "").collect()}
    assert passages.stage(spark, df, "").columns == df.columns
    assert sorted(out) == [1, 2, 3, 4] and out[1]["text"] == texts[0][1] and out[3]["text"] == "untouched  text\n" and out[4]["text"] is None
    assert out[2]["text"].split() == ["first", "line", "last", "line"] and out[2]["n_chars"] == len(out[2]["text"])
    assert passages.passages(df.limit(0)).count() == 0


def test_chain_equals_quadratic():
    rng = np.random.default_rng(12)
    c = passages.Config()
    for _ in range(30):
        n = int(rng.integers(2, 12))
        a = np.sort(rng.integers(0, 150, n))
        last = a + rng.integers(0, 10, n)
        b = rng.integers(0, 150, n)
        weight = last - a + c.k
        score = [0.0] * n
        for i in sorted(range(n), key=lambda i: (a[i], i)):
            best = 0.0
            for j in range(n):
                if last[j] < a[i] and b[j] + last[j] - a[j] < b[i]:
                    best = max(best, score[j] - c.gap_cost * float(a[i] - last[j] + b[i] - (b[j] + last[j] - a[j])))
            score[i] = float(weight[i]) + best
        got = passages.chain(a, last, b - a, weight, passages.Config(gap=10_000))
        assert sorted(i for p in got for i in p) == list(range(n))
        top = got[0]
        value = sum(float(weight[i]) for i in top) - sum(c.gap_cost * float(a[j] - last[i] + b[j] - (b[i] + last[i] - a[i])) for i, j in zip(top, top[1:], strict=False))
        assert value == pytest.approx(max(score))


def test_chain_equals_quadratic_at_the_gap():
    rng = np.random.default_rng(13)
    c = passages.Config()
    for _ in range(60):
        n = int(rng.integers(2, 30))
        a = np.sort(rng.integers(0, 600, n))
        last = a + rng.integers(0, 120, n)
        b = np.maximum(a + rng.integers(-60, 60, n), 0)
        b_last, weight = b + last - a, last - a + c.k
        score = [0.0] * n
        for i in sorted(range(n), key=lambda i: (a[i], i)):
            near = [j for j in range(n) if 0 < a[i] - last[j] <= c.gap + c.k and 0 < b[i] - b_last[j] <= c.gap + c.k]
            score[i] = float(weight[i]) + max([0.0, *[score[j] - c.gap_cost * float(a[i] - last[j] + b[i] - b_last[j]) for j in near]])
        top = passages.chain(a, last, b - a, weight, c)[0]
        value = sum(float(weight[i]) for i in top) - sum(c.gap_cost * float(a[j] - last[i] + b[j] - b_last[i]) for i, j in zip(top, top[1:], strict=False))
        assert value == pytest.approx(max(score))


def test_long_block_hides_no_later_passage(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    block, passage, fill = [word() for _ in range(400)], [word() for _ in range(70)], lambda n: [word() for _ in range(n)]
    texts = [block + fill(80) + passage, block + fill(80) + passage[:35] + fill(1) + passage[35:]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    spans = sorted((r["start"], r["end"]) for r in passages.passages(df).collect())
    assert spans == [(0, 400), (480, 551)]


def test_passage_of_sentences_seen_before(spark):
    rng = random.Random(15)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    one, two = fill(30), fill(30)
    texts = {1: fill(20) + one + fill(20), 2: fill(20) + two + fill(20)} | {i: fill(9) + one + fill(9) for i in (600, 700)} | {i: fill(9) + two + fill(9) for i in (650, 800)}
    texts |= {i: fill(30) + one + two + fill(30) for i in (500, 900)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    out = [(r["doc_id"], r["ref_doc_id"], r["start"], r["end"], r["ref_start"]) for r in passages.passages(df).collect()]
    assert out == [(900, 500, 30, 90, 30)]


def test_verbatim_words_survive_what_surrounds_them(spark):
    rng = random.Random(16)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    ends, passage = [fill(12), fill(12)], fill(50)
    df = spark.createDataFrame([(i, " ".join(fill(20) + ends[0] + fill(22) + passage + fill(22) + ends[1] + fill(20))) for i in range(2)], "doc_id long, text string")
    ((start, end),) = [(r["start"], r["end"]) for r in passages.passages(df).collect()]
    assert start <= 54 and end >= 104


def test_all_verbatim_passages_by_brute_force(spark):
    """Random documents that quote fragments of each other: every run of 50 words that an earlier document
    holds too is covered, wherever the first occurrences of its parts lie; what is reported is so."""
    rng = random.Random(44)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    texts = [fill(rng.randint(60, 200)) for _ in range(12)]
    for _ in range(60):
        own: list[str] = []
        for _ in range(rng.randint(1, 5)):
            source = rng.choice(texts)
            at = rng.randrange(len(source))
            own += fill(rng.randint(0, 30)) + source[at : at + rng.randint(10, 120)]
        texts.append(own + fill(rng.randint(0, 20)))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3, "doc_id")
    found = passages.passages(df).collect()
    covered = collections.defaultdict(set)
    for r in found:
        assert r["ref_doc_id"] < r["doc_id"] and r["similarity"] >= 0.8
        covered[r["doc_id"]].update(range(r["start"], r["end"]))
    seen: dict[tuple, int] = {}
    for i, t in enumerate(texts):
        runs = {tuple(t[j : j + 50]): j for j in range(len(t) - 49)}
        for run, j in runs.items():
            assert seen.get(run, i) == i or set(range(j, j + 50)) <= covered[i], (i, j)
        for run in runs:
            seen.setdefault(run, i)


def test_scattered_first_occurrences(spark):
    """An exact passage of 120 words, of which eight earlier documents quote 25 words each."""
    rng = random.Random(45)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage = fill(120)
    texts = {i: fill(10) + passage[14 * i : 14 * i + 25] + fill(10) for i in range(8)}
    texts |= {100: fill(20) + passage + fill(9), 101: fill(33) + passage + fill(9)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    out = [tuple(r)[:6] for r in passages.passages(df).collect()]
    assert out == [(101, 33, 153, 100, 20, 140)]


def test_fuzzy_passages_are_mostly_found(spark):
    """Of passages of 80 words with every tenth word replaced at random, at least nine in ten."""
    rng = random.Random(46)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    rows = []
    for i in range(100):
        passage = fill(80)
        other = [fill(1)[0] if rng.random() < 0.1 else w for w in passage]
        rows += [(2 * i, " ".join(fill(30) + passage + fill(30))), (2 * i + 1, " ".join(fill(20) + other + fill(40)))]
    out = passages.passages(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "ref_doc_id").distinct().collect()
    assert all(r["ref_doc_id"] == r["doc_id"] - 1 for r in out) and len(out) >= 90


def test_fuzzy_passage_of_words_quoted_before(spark):
    """Documents 3 and 4 share 80 words, four of them replaced; earlier documents quote 24 words each."""
    rng = random.Random(47)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    passage = fill(80)
    fuzzy = [fill(1)[0] if i in (9, 29, 49, 69) else w for i, w in enumerate(passage)]
    texts = {3: fill(20) + passage + fill(20), 4: fill(30) + fuzzy + fill(10)}
    texts = {i - 10: fill(20) + passage[a : a + 24] + fill(20) for i, a in enumerate(range(0, 72, 12))} | texts
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").coalesce(1)
    assert [(r["doc_id"], r["ref_doc_id"]) for r in passages.passages(df).collect()] == [(4, 3)]


def test_fuzzy_passages_do_not_depend_on_other_documents(spark):
    """Pairs of documents that share a passage with words replaced, left out and put in: those found alone are
    found after documents that quote random parts of each, whether those come in one map task or in many."""
    rng = random.Random(48)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    edits = [lambda w: fill(1)] * 6 + [lambda w: [], lambda w: [w, *fill(1)]]
    pairs, quotes = {}, []
    for i in range(24):
        passage = fill(rng.randint(60, 110))
        other = [x for w in passage for x in (rng.choice(edits)(w) if rng.random() < 0.12 else [w])]
        pairs |= {1000 + 2 * i: fill(20) + passage + fill(30), 1001 + 2 * i: fill(40) + other + fill(10)}
        quotes += [fill(10) + passage[j : j + 22] + fill(10) for j in range(0, len(passage), 9)]
        quotes += [fill(5) + other[j : j + 25] + fill(15) for j in range(4, len(other), 10)]
    rng.shuffle(quotes)
    frame = lambda texts, n: spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string").repartition(n)
    found = lambda df: {(r["doc_id"], r["ref_doc_id"]) for r in passages.passages(df).collect()}
    alone = found(frame(pairs, 1))
    assert len(alone) >= 18 and all(a == b + 1 for a, b in alone)
    assert found(frame(dict(enumerate(quotes)) | pairs, 1)) == alone
    assert found(frame(dict(enumerate(quotes)) | pairs, 7)) == alone


def test_common_line_is_not_paired(spark, monkeypatch):
    """A line that many texts hold, and some twice, makes no matches of texts that share no more than it."""
    rng = random.Random(49)
    fill = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n)]
    line = fill(16)
    texts = [fill(40) + line + fill(40) for _ in range(120)] + [fill(70) + line + fill(14) + line + fill(70) for _ in range(20)]
    made, real = [], passages.chains

    def counted(found, config):
        made.append(found.count())
        return real(found, config)

    monkeypatch.setattr(passages, "chains", counted)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert passages.passages(df).filter("doc_id < 120").count() == 0
    assert made[-1] < 20 * 120


def test_fewest_passages(spark):
    """Of references of the same words the first stays, of two documents' passages those that no others cover."""
    rows = [(30, 5, 85, 11, 7, 87, 0.9, b"a"), (30, 5, 85, 10, 3, 83, 0.9, b"a"), (30, 5, 85, 20, 1, 81, 0.95, b"b")]
    rows += [(30, 20, 75, 20, 16, 71, 0.95, b"c"), (30, 60, 120, 20, 56, 116, 0.9, b"d"), (31, 20, 75, 20, 16, 71, 0.95, b"c")]
    found = passages.fewest(spark.createDataFrame(rows, passages.PASSAGE + ", copy binary").repartition(3)).collect()
    assert sorted(tuple(r)[:4] for r in found) == [(30, 5, 85, 10), (30, 5, 85, 20), (30, 60, 120, 20), (31, 20, 75, 20)]


def test_packing_leaves_no_tokenizers_in_workers(spark):
    """Workers serve other stages afterwards, whose memory they share."""
    import pyarrow as pa

    docs = spark.createDataFrame([(i, f"text {i} of some words " * 40) for i in range(64)], "doc_id long, text string").repartition(8)
    assert packing.packed(docs).count() >= 64

    def kept(batches):
        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(packing._tokenizers)])], names=["n"])

    assert spark.range(0, 64, 1, 16).mapInArrow(kept, "n long").agg({"n": "max"}).first()[0] == 0


def test_cover_keeps_every_word():
    rng = np.random.default_rng(17)
    words = lambda a, b: set().union(*(range(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)))
    for _ in range(200):
        a = rng.integers(0, 100, int(rng.integers(1, 40)))
        b = a + rng.integers(1, 20, len(a))
        at = passages.cover(a, b)
        assert words(a[at], b[at]) == words(a, b) and len(set(at.tolist())) == len(at)
    assert passages.cover(np.arange(150), np.arange(150) + 50).tolist() == [0, 50, 100, 149]


# --- pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    rows = docs.collect()
    kept = {r["doc_id"]: r["text"] for r in rows}
    assert len(kept) == len(rows) and set(kept) <= set(before)
    assert len(set(kept.values())) == len(kept)  # no exact copies are left
    packed = pipeline.run(spark, sf_dir)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == set(kept)
