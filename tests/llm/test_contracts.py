"""Brute force, clashing names, id types and layouts for the training-data operators."""

import itertools
import math
import random
import struct
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tilewright.llm import chat, common, gru, kneser_ney, langid, lm, media, mixing, neardup, packing

WORDS = {"aa": ["kala", "mano", "tiki", "lopa", "sule"], "bb": ["strung", "welcht", "borg", "frind", "klar"], "cc": ["qui", "vous", "leau", "dont", "pour"]}


# ---- language id: the tables and the decoding, written out ----


def plain_language(train, texts):
    """Log-odds tables from plain counts, and the codeword with the least weighted loss."""
    names = sorted({k for _, k in train})
    code = langid.codewords(len(names))

    def buckets(text):
        raw = b"  " + text.lower().encode() + b"  "
        raw = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in raw)
        out = []
        for i in range(len(raw)):
            four = (raw[i : i + 4] + b"    ")[:4]
            if four[:2] == b"  ":
                continue
            three = int.from_bytes(four[:3], "big")
            out.append(three * 2654435761 % (1 << 32) >> 32 - langid.BITS)
            out.append((int.from_bytes(four, "big") * 2246822519 % (1 << 32) >> 32 - langid.BITS) + (1 << langid.BITS))
        return out

    counts = {k: Counter() for k in names}
    for text, k in train:
        counts[k].update(buckets(text))
    half = 1 << langid.BITS

    def share(k, b):
        side = [v for g, v in counts[k].items() if g // half == b // half]
        return (counts[k][b] + 0.5) / (sum(side) + 0.5 * half)

    def margins(text):
        found = buckets(text)
        out = []
        for bit in code.T:
            odds = [np.log(np.mean([share(k, b) for k, s in zip(names, bit, strict=True) if s > 0])) - np.log(np.mean([share(k, b) for k, s in zip(names, bit, strict=True) if s < 0])) for b in found]
            out.append(np.mean(odds) if odds else 0.0)
        return np.array(out)

    z = {k: np.array([margins(t) for t, x in train if x == k]) for k in names}
    mean = np.array([z[k].mean(0) for k in names])
    var = np.array([np.maximum((z[k] ** 2).mean(0) - z[k].mean(0) ** 2, 1e-4) for k in names])
    high, low = np.array([mean[c > 0, b].mean() for b, c in enumerate(code.T)]), np.array([mean[c < 0, b].mean() for b, c in enumerate(code.T)])
    middle, slope = (high + low) / 2, (high - low) / var.mean(0)
    right = code * (mean - middle) / np.sqrt(var)
    weight = np.maximum([[0.5 * (1 + math.erf(x / math.sqrt(2))) for x in row] for row in right], 0.01)
    out = []
    for text in texts:
        bits = slope * (margins(text) - middle)
        loss = [sum(w * np.log1p(np.exp(-c * x)) for w, c, x in zip(weight[i], code[i], bits, strict=True)) / weight[i].sum() for i in range(len(names))]
        out.append(names[int(np.argmin(loss))])
    return out


def test_language_equals_plain_decoding(spark):
    rng = random.Random(2)
    train = [(" ".join(rng.choices(WORDS[k], k=6)), k) for _ in range(12) for k in WORDS]
    texts = [" ".join(rng.choices(WORDS[a] + WORDS[b], k=5)) for a, b in itertools.combinations_with_replacement(WORDS, 2) for _ in range(4)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == plain_language(train, texts)


def test_random_codewords_lie_apart():
    code = langid.codewords(20)
    apart = (code[:, None] != code[None]).sum(2)
    assert apart[~np.eye(20, dtype=bool)].min() >= code.shape[1] / 5


def test_kept_columns_with_result_names(spark):
    docs = spark.createDataFrame([(1, "kala mano", "aa", 0.5, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    found = langid.predict(docs, langid.fit(docs), docs.columns)
    assert found.columns == ["doc_id", "text", "lang", "score_", "lang_pred_", "lang_pred", "score", "ambiguous"]
    assert found.first()["score_"] == 0.5


# ---- quality: a plain modified Kneser-Ney model ----


def plain_kneser_ney(train, texts):
    grams = [["<s>", "<s>", *t.split(), "</s>"] for t in train]
    three = Counter(tuple(g[i : i + 3]) for g in grams for i in range(len(g) - 2))
    two, raw = Counter(), Counter()
    for (a, b, c), n in three.items():
        two[b, c] += 1
        raw[b, c] += n
    two = Counter({(b, c): raw[b, c] if b == "<s>" else n for (b, c), n in two.items()})
    one = Counter(c for _, c in two)

    def discounts(counts):
        n1, n2, n3, n4 = (max(sum(v == k for v in counts.values()), 1) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        return [min(max(x, 0.05), top) for x, top in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.9), (3 - 4 * y * n4 / n3, 2.8))]

    d3, d2, d1 = map(discounts, (three, two, one))
    off = lambda d, n: d[min(n, 3) - 1]
    total = sum(one.values())
    floor = (1 - sum(n - off(d1, n) for n in one.values()) / total) / (len(one) + 1)

    def p1(c):
        return ((one[c] - off(d1, one[c])) / total if one[c] else 0) + floor

    def p2(b, c):
        of = {x: n for (y, x), n in two.items() if y == b}
        if not of:
            return p1(c)
        n = sum(of.values())
        return ((of[c] - off(d2, of[c])) / n if c in of else 0) + sum(off(d2, x) for x in of.values()) / n * p1(c)

    def p3(a, b, c):
        of = {z: n for (x, y, z), n in three.items() if (x, y) == (a, b)}
        if not of:
            return p2(b, c)
        n = sum(of.values())
        return ((of[c] - off(d3, of[c])) / n if c in of else 0) + sum(off(d3, x) for x in of.values()) / n * p2(b, c)

    logs = []
    for t in texts:
        g = ["<s>", "<s>", *t.split(), "</s>"]
        logs.append(-sum(math.log(p3(*g[i : i + 3])) for i in range(len(g) - 2)) / (len(g) - 2))
    vocabulary = list(one)
    sums = [sum(p3(a, b, c) for c in [*vocabulary, "never seen"]) for a, b in (("<s>", "<s>"), (vocabulary[0], vocabulary[1]), ("x1", "x2"))]
    return logs, sums


def test_perplexity_equals_plain_model(spark):
    rng = random.Random(9)
    train = [" ".join(rng.choices("a b c d e f g".split(), k=rng.randint(1, 12))) for _ in range(40)]
    texts = ["a b c", "zz a zz", "", "g g g g", *train[:3], "a b c " * 400]
    want, sums = plain_kneser_ney(train, texts)
    assert all(math.isclose(s, 1, rel_tol=1e-9) for s in sums)
    tables = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    looked = kneser_ney.score(docs, tables.lookup(), ["doc_id"]).orderBy("doc_id").collect()
    joined = kneser_ney.score_joined(docs, tables, ["doc_id"]).orderBy("doc_id").collect()
    assert np.allclose([r.log_perplexity for r in looked], want, rtol=1e-5)
    assert np.allclose([r.log_perplexity for r in joined], want, rtol=1e-9)
    assert [r.n_words for r in looked] == [r.n_words for r in joined] == [len(t.split()) for t in texts]
    assert tables.lookup(table_rows=3) is None


def test_large_models_are_joined(spark):
    rows = [(i, "en", " ".join(random.Random(i).choices("a b c d".split(), k=9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    labels = docs.selectExpr("doc_id", "1 as quality")
    a, b = (sorted((r.doc_id, round(r.perplexity, 3), r.keep) for r in kneser_ney.classify(docs, labels, table_rows=n).collect()) for n in (2, 100_000))
    assert a == b


@pytest.mark.parametrize("options", [{}, {"table_rows": 2, "broadcast_rows": 0}])
def test_every_trusted_document_is_counted(spark, options):
    rng = random.Random(4)
    rows = [(i, "en" if i % 3 else None, " ".join(rng.choices("a b c d e f".split(), k=rng.randint(0, 9)))) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)
    labels = docs.selectExpr("doc_id", "int(doc_id < 60) as quality")
    half = {r.doc_id: r.half for r in docs.where("doc_id < 60").selectExpr("doc_id", "int(pmod(xxhash64(11, doc_id), 2L)) as half").collect()}
    assert set(half.values()) == {0, 1}
    logs = [plain_kneser_ney([t for d, _, t in rows if half.get(d) == i], [t for _, _, t in rows])[0] for i in (0, 1)]
    want = {d: logs[1 - half[d]][d] if d in half else (logs[0][d] + logs[1][d]) / 2 for d, _, _ in rows}
    limit = {}
    for lang in ("en", None):
        values = sorted(want[d] for d, x, _ in rows if x == lang and d in half)
        limit[lang] = values[math.ceil(0.5 * len(values)) - 1]
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, quantile=0.5, **options).collect()}
    assert len(got) == len(rows)
    for d, lang, t in rows:
        r = got[d]
        assert r.n_words == len(t.split()) and math.isclose(math.log(r.perplexity), want[d], rel_tol=1e-5)
        assert math.isclose(math.log(r.threshold), limit[lang], rel_tol=1e-5)
        assert r.keep == (want[d] <= limit[lang]) or math.isclose(want[d], limit[lang], rel_tol=1e-5)


def test_written_tables_leave_no_shuffle_files(spark):
    left = lambda: spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()
    spark._jvm.System.gc()
    before, setting = left(), spark.conf.get(common.CLEAN_UP)
    common.materialise(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count(), "clean-up")
    assert left() <= before and spark.conf.get(common.CLEAN_UP) == setting


def test_models_are_deleted_when_documents_are_scored(spark):
    rows = [(i, "en", " ".join(random.Random(i).choices("a b c d".split(), k=9))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    there = lambda: set(Path(common.shared_dir(spark).removeprefix("file://")).glob("kn-*"))
    before = there()
    assert kneser_ney.classify(docs, docs.selectExpr("doc_id", "1 as quality"), table_rows=2).count() == 60
    assert {x.name.rsplit("-", 1)[0] for x in there() - before} == {"kn-trusted", "kn-scores"}


def test_values_join_trigrams_once(spark):
    """A trigram's context is counted beside it, so only the lower order is joined."""
    tables = kneser_ney.fit(spark.createDataFrame([("a b c a b d",)], "text string"))
    rest = {(r.a, r.b): r.p for r in tables.rest3.collect()}
    assert all(r.rest == rest[r.a, r.b] for r in tables.three.collect())


def test_joined_scores_do_not_depend_on_shards(spark):
    rng = random.Random(6)
    train = [" ".join(rng.choices("a b c d e f g h".split(), k=12)) for _ in range(50)]
    tables = kneser_ney.fit(spark.createDataFrame([(t,) for t in train], "text string"))
    docs = spark.createDataFrame([*enumerate(["", "a b", "z z z", "a b c d " * 50, *train[:9]]), (None, None)], "doc_id long, text string").repartition(4)
    one, many = (sorted((str(r.doc_id), r.n_words, round(r.log_perplexity, 9)) for r in kneser_ney.score_joined(docs, tables, ["doc_id"], **k).collect()) for k in ({}, {"shard_chars": 10, "shard_rows": 7}))
    assert one == many and len(one) == 14


# ---- packing, chat: ids of any type ----


def test_tokens_equal_the_tokenizer(spark):
    rng = random.Random(4)
    parts = ["a", "word", " ", "  ", "\n", "\t", "it's", "12", "ü", "漢字", "!?", "<|x|>", "'ll", " ", "é"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)]
    ids, counts = packing.encode_texts(pa.array(texts))
    whole = packing.load_tokenizer(packing.TOKENIZER)
    want = [whole.encode_ordinary(t) for t in texts]
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "doc_id string, text string")
    packed = packing.pack_documents(docs, row=32)
    assert sorted(x or "" for r in packed.collect() for x in r.doc_ids) == ["", "a", "b"]
    assert {r.doc_id for r in packing.unpack_documents(packed).collect()} == {"a", "b", None}
    turns = spark.createDataFrame([("c1", 1, "user", "hi"), ("c1", 2, "assistant", "yo"), ("c2", 1, "assistant", "x")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r.n_turns for r in chat.digest_conversations(chat.format_turns(turns)).collect()}
    assert got == {"c1": 2, "c2": 1}
    assert chat.place_turns(chat.format_turns(turns)).count() == 3


# ---- mixing: quotas of shards and pieces, layouts ----


def test_pieces_are_what_is_taken(spark):
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i % 37)), "ab"[i % 3 > 0]) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs, keep=("source",), block=16, shard_words=500).collect()
    for r in plan:
        assert r.taken == r.epochs * r["size"] + sum(p.end - p.begin for p in r.parts)
        ends = [0, *(x for p in r.parts for x in (p.begin, p.end)), r["size"]]
        assert ends == sorted(ends)
    mixed = Counter(w for r in mixing.mix_documents(docs, block=16, shard_words=500).collect() for w in (r.text or "").split())
    want = Counter()
    for r in plan:
        words = rows[r.doc_id][1].split()
        for _ in range(r.epochs):
            want.update(words)
        for p in r.parts:
            want.update(words[p.begin : p.end])
    assert mixed == want


def test_the_mix_does_not_depend_on_the_layout(spark):
    rows = [(None if i % 50 == 0 else i, f"text {i} " * (i % 9), "ab"[i % 3 > 0], i, "x") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, epochs int, key_ string")
    a, b = (sorted((r.doc_id or -1, r.text, r.epochs) for r in mixing.mix_documents(d, block=8, shard_words=200).collect()) for d in (docs, docs.repartition(7, "text")))
    assert a == b
    assert mixing.mix_documents(docs).columns == docs.columns


# ---- language model: a plain recurrent network ----


def plain_score(p, shape, ids):
    """One document, token by token, in double precision."""
    p = {k: v.astype(float) for k, v in p.items()}
    h, out, x = np.zeros(shape.hidden), 0.0, 0
    cls = shape.class_of()
    n = shape.hidden
    for y in [*ids, 0]:
        a, g = p["x"][x], h @ p["u"]
        r, z = 1 / (1 + np.exp(-(a[:n] + g[:n]))), 1 / (1 + np.exp(-(a[n : 2 * n] + g[n : 2 * n])))
        new = np.tanh(a[2 * n :] + r * g[2 * n :])
        h = new + z * (h - new)
        logits = h @ p["cw"] + p["cb"]
        out += logits[cls[y]] - np.log(np.exp(logits).sum())
        if cls[y] < len(shape.bounds) - 1:
            lo, hi = shape.bounds[cls[y]], shape.bounds[cls[y] + 1]
            words = p["ww"][lo:hi] @ h + p["wb"][lo:hi]
            out += words[y - lo] - np.log(np.exp(words).sum())
        x = y
    return out


def test_scores_equal_a_plain_network():
    rng = np.random.default_rng(3)
    shape = gru.Shape(6, np.array([0, 1, 4, 9]), 3)
    p = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in gru.initial(shape, rng.integers(1, 50, 12)).items()}
    docs = [rng.integers(1, 12, n) for n in (0, 1, 5, 70, 33)]
    lengths = np.array([len(d) for d in docs])
    ids = np.concatenate(docs).astype(np.int32)
    for lanes, window in ((1, 8), (4, 7), (1024, 32)):
        got = gru.score(p, shape, ids, np.cumsum(lengths) - lengths, lengths, lanes=lanes, window=window)
        assert np.allclose(got, [plain_score(p, shape, d.tolist()) for d in docs], rtol=1e-4)


def test_gradients_equal_differences(monkeypatch):
    monkeypatch.setattr(gru, "f32", np.float64)
    rng = np.random.default_rng(0)
    shape = gru.Shape(5, np.array([0, 1, 3, 6]), 2)
    p = {k: v.astype(float) for k, v in gru.initial(shape, np.full(8, 5.0)).items()}
    x, y, fresh = rng.integers(0, 8, (7, 3)), rng.integers(0, 8, (7, 3)), np.zeros((7, 3), bool)
    fresh[0], fresh[4, 1] = True, True
    y[6, 2] = -1
    cls = shape.class_of()

    def loss():
        h, out = np.zeros((3, 5)), 0.0
        for t in range(7):
            h = gru.forward(p, x[t : t + 1], fresh[t : t + 1], h, gru.Buffers())[0][0]
            live = y[t] >= 0
            out -= gru.token_logs(p, shape, cls, h[live], y[t][live], gru.Buffers()).sum()
        return out

    cw, cb, u, words, (rows, gx), _ = gru.window_gradients(p, shape, cls, x, y, fresh, np.zeros((3, 5)), 1.0, gru.Buffers())

    def difference(k, at):
        old = p[k][at]
        p[k][at] = old + 1e-5
        high = loss()
        p[k][at] = old - 1e-5
        low = loss()
        p[k][at] = old
        return (high - low) / 2e-5

    checks = [(cw[2, 3], "cw", (2, 3)), (cb[1], "cb", 1), *((u[i], "u", i) for i in ((1, 7), (2, 12), (0, 3))), *((gx[j, 11], "x", (rows[j], 11)) for j in range(len(rows)))]
    checks += [c for at, g, gb in words for c in ((g[0, 1], "ww", (at.start, 1)), (gb[1], "wb", at.start + 1))]
    for got, k, at in checks:
        assert math.isclose(got, difference(k, at), rel_tol=1e-4, abs_tol=1e-7), (k, at)


def test_white_space_around_a_space_encodes_as_in_whole_texts():
    space = ["\n", "\t", "\x0b", "\x85", "\xa0", "\u3000", "\u2028", "", "\r\n"]
    texts = [f"foo{a} {b}bar é{b}" for a in space for b in space] + [f"foo{a} " for a in space] + [f" {a}x {a}" for a in space]
    texts += [" ".join(random.Random(i).choices(["a", "don't", "\nx", "y\n", "\n", "\u3000", "漢字", "...", "\x1c", "l" * 60, "\x00"], k=30)) for i in range(40)]
    enc = packing.load_tokenizer(packing.TOKENIZER)
    ids, counts = packing.encode_texts(pa.array(texts))
    ends = np.cumsum(counts)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)] == [enc.encode_ordinary(t) for t in texts]


def test_words_are_encoded_in_one_call(monkeypatch):
    enc, calls = packing.load_tokenizer(packing.TOKENIZER), []

    class Counted:
        max_token_value, decode_single_token_bytes = enc.max_token_value, staticmethod(enc.decode_single_token_bytes)

        def encode_ordinary(self, text):
            calls.append(text)
            return enc.encode_ordinary(text)

    monkeypatch.setattr(packing, "load_tokenizer", lambda path: Counted())
    texts = [" ".join(f"w{i}x{k}" for k in range(50)) for i in range(100)]
    ids, _ = packing.encode_texts(pa.array(texts))
    assert ids.tolist() == [i for t in texts for i in enc.encode_ordinary(t)]
    assert len(calls) <= len(texts) + 2


def test_a_batch_is_looked_up_in_parts():
    rng = random.Random(8)
    texts = pa.array([None, "", "zz " * 3, *(" ".join(rng.choices("a b c dd ee never rare".split(), k=2000)) for _ in range(300)), ""])
    words = ["a", "b", "c", "dd", "ee"]
    vocabulary = lm.Vocabulary(pa.array(words), np.array([9, 8, 7, 6, 5]), 4, np.ones((2, 2), np.int64) * 100, 400, 9, 2, 2, 2, 4)
    batch, log_base = pa.RecordBatch.from_arrays([texts], ["text"]), np.log10(np.arange(1.0, 6))
    n, found, peak = 600_003, [], []
    for part_bytes in (1 << 16, 1 << 40):
        tracemalloc.start()
        found.append(lm.looked_up(batch, vocabulary, log_base, part_bytes))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peak[0] < 12 * n < 24 * n < peak[1]
    assert all((found[0][i] == found[1][i]).all() for i in (0, 1)) and found[0][2]["rare"].to_pylist() == found[1][2]["rare"].to_pylist()
    assert len(found[0][0]) == n and all(np.allclose(found[0][2][c], found[1][2][c]) for c in ("has", "base", "share"))
    t = texts[9].as_py().split()
    assert found[0][2]["has"][9].as_py() == sum(w in words for w in t) and found[0][2]["rare"][9].as_py() == [w for w in t if w not in words]
    assert math.isclose(found[0][2]["base"][9].as_py(), sum(log_base[words.index(w)] for w in t if w in words))


def test_batches_are_scored_together_without_their_texts():
    rng = random.Random(9)
    vocabulary = lm.Vocabulary(pa.array(["a", "b", "c"]), np.array([9, 8, 7]), 4, np.ones((2, 2), np.int64) * 100, 400, 9, 2, 2, 2, 4)
    log_base, text = np.log10(np.arange(1.0, 4)), lambda: " ".join(rng.choices(["a", "b", "c", "never"], k=2000))
    rows = [(i, text() if i % 9 else None) for i in range(900)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], ["k0", "text"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        for i in range(0, 900, 30):
            out.write_batch(batch.slice(i, 30))
    stream = sink.getvalue().to_pybytes()
    ids, lengths, of = lm.looked_up(batch.select([1]), vocabulary, log_base)
    got, held = [], []

    def read():  # a copy of each batch, whose memory counts
        for b in pa.ipc.open_stream(pa.BufferReader(stream)):
            held.append(pa.total_allocated_bytes())
            yield b.take(pa.array(range(len(b))))

    for part in lm.gathered(read(), 1, vocabulary, log_base, most=10**6):
        got.append(part)
    assert [len(p[0]) >= 10**6 for p in got] == [True, False] and sum(len(p[0]) for p in got) == 1_600_000
    assert (np.concatenate([p[0] for p in got]) == ids).all() and (np.concatenate([p[1] for p in got]) == lengths).all()
    table = pa.concat_tables([p[2] for p in got])
    assert table["k0"].to_pylist() == list(range(900)) and all(table[c].to_pylist() == of[c].to_pylist() for c in ("has", "base", "share"))
    rare = sum(len(w) for x in of["rare"].to_pylist() for w in x)
    assert max(held) - held[0] < rare + 4 * 400_000 + len(stream) // 4


def test_targets_of_a_layout_are_its_inputs():
    lengths = np.array([4, 0, 7, 1, 2])
    ids = np.arange(1, 15, dtype=np.int32)
    x, y, fresh, doc, running = gru.layout(ids, np.cumsum(lengths) - lengths, lengths, 2, 3)
    assert np.shares_memory(x, y)
    found = {}
    for t in range(len(x)):
        for k in range(running[t]):
            found.setdefault(int(doc[t, k]), []).append((bool(fresh[t, k]), int(x[t, k]), int(y[t, k])))
    for d, (low, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        t = ids[low : low + n].tolist()
        assert found[d] == list(zip([True] + [False] * n, [0, *t], [*t, 0], strict=True))


def test_scores_do_not_depend_on_the_layout(spark):
    rows = [(i, " ".join(random.Random(i).choices("a b c d e".split(), k=i % 13))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("train", F.col("doc_id") % 7 != 2)
    a, b = (sorted((r.doc_id, round(r.score, 3), r.n_known) for r in lm.score_documents(d, d["train"], ("doc_id",), words=8, classes=2, n_tails=2, hidden=4, shard_tokens=200).collect()) for d in (docs, docs.repartition(5)))
    assert a == b


# ---- media: validators, plain search, digests ----


def png():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0abc\0def")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 4, 5, 0x80, 0, 0) + bytes(6) + b"\x21\xf9\x04\0\0\0\0\0" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 4, 5, 0) + b"\x02\x02\x44\x01\0\x3b"


def jpeg():
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 6, 7, 1) + b"\1\x11\0" + b"\xff\xda" + struct.pack(">H", 3) + b"\1" + b"data\xff\xd9"


def au():
    return b".snd" + struct.pack(">IIIII", 24, 10, 1, 8000, 2) + b"0123456789"


def squeezed():
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(b"hello" * 50) + pack.flush()


FILES = {"image/png": png(), "image/gif": gif(), "image/jpeg": jpeg(), "audio/basic": au(), "application/gzip": squeezed()}


@pytest.mark.parametrize("kind", sorted(FILES))
def test_validators(kind):
    data = FILES[kind]
    (found,) = [f for f in media.sniff(b"..." + data + b"...") if f[0] == kind]
    assert (found[1], found[2]) == (3, 3 + len(data))
    assert not [f for f in media.sniff(b"..." + data[:-1]) if f[0] == kind]
    assert "5" in found[5] or "width" in found[5] or "channels=2" in found[5]


def test_damaged_files_are_not_confirmed():
    bad = bytearray(png())
    bad[-6] ^= 1
    assert not media.sniff(bytes(bad))
    assert not media.sniff(b"GIF89a" + bytes(20)) and not media.sniff(b".snd" + bytes(20)) and not media.sniff(b"\xff\xd8\xff\xe0\0\1ab")


def plain_sniff(data):
    """Every magic number by plain search, validated from the left."""
    hits = sorted((i, kind) for magic, back, kind in media.MAGIC for i in range(len(data)) if data[i : i + len(magic)] == magic)
    found, free = [], 0
    for at, kind in hits:
        if (not at or at >= free) and (got := media.VALIDATORS[kind](data, at)):
            found.append((kind, at, got[0]))
            free = got[0] if at else free
    return found


def test_sniffing_equals_plain_search():
    rng = random.Random(7)
    parts = [*FILES.values(), media.to_media(b"z" * 576), media.to_media(b"y" * 1152), b"RIFF", b"BM", b"P5\n", b"noise", b"\xff\xd8\xff", bytes(9)]
    for _ in range(150):
        data = b"".join(rng.choices(parts, k=rng.randint(0, 6)))
        assert [f[:3] for f in media.sniff(data)] == plain_sniff(data)


def test_digests_equal_plain_ones(spark):
    rows = [(1, "a" * 577), (2, None), (3, "ü" * 288), (4, "P5\nRIFF"), (5, "a" * 577)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = media.sniff_media(media.store_as_media(docs), "media", "declared_type", ["doc_id", "n_bytes", "media"])
    got = {r.doc_id: r for r in found.select("doc_id", "n_bytes", "data", F.crc32(F.expr("substring(data, -32, 32)")).alias("tail"), F.sha2("media", 256).alias("m")).collect()}
    for d, t in rows:
        raw = (t or "").encode()
        payload = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        assert bytes(got[d].data) == payload and got[d].n_bytes == len(raw) and got[d].tail == zlib.crc32(payload[-32:])
    assert got[1].m == got[5].m


# ---- near duplicates ----


def test_buckets_beyond_the_broadcast_bound(spark):
    from tests.llm.test_neardup import brute, corpus

    rows = corpus()[-70:]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, small_bucket=4, broadcast_rows=0).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}


def test_repeated_rows_keep_one_by_all_columns(spark):
    rows = [(1, "a b c d e f", k) for k in "xyz"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row_key_ string")
    a, b = (neardup.drop_near_duplicates(d).collect() for d in (docs, docs.orderBy(F.desc("row_key_")).coalesce(1)))
    assert len(a) == 1 and a == b
