"""The other operators: defined cases, round trips and brute force on small tables."""

import base64
import gzip
import hashlib
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tilewright.llm import chat, decontaminate, gru, kneser_ney, langid, lm, media, mixing, packing, warc

ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two three"), (4, "one two three"), (None, "ünï ☃ 漢字 " * 500), (5, "123 456")]
SCHEMA = "doc_id long, text string"


@pytest.fixture
def odd(spark):
    """Odd texts, with extra columns whose names the operators use inside."""
    rows = [(d, t, None if i % 3 else "s", None if i % 2 else "en", i, "x") for i, (d, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, SCHEMA + ", source string, lang string, row_id int, words string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA + ", source string, lang string")


# ---- language id ----


def test_language_id(spark, odd, none):
    rng = random.Random(5)
    words = {"aa": ["kala", "mano", "tiki", "lopa"], "bb": ["strung", "welcht", "borg", "frind"], "cc": ["qui", "vous", "leau", "dont"]}
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i in range(240) for k in [("aa", "bb", "cc")[i % 3]]]
    docs = spark.createDataFrame(rows, SCHEMA + ", lang string")
    model = langid.fit(docs.where("doc_id < 160"))
    found = langid.predict(docs.where("doc_id >= 160"), model, ["doc_id", "lang"]).collect()
    assert sum(r.lang == r.lang_pred for r in found) >= 0.95 * len(found)
    assert all(0 <= r.score <= 1 for r in found)
    got = langid.predict(odd, model, ["doc_id", "text"]).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred == "und") == (not r.text or not any(c.isalpha() for c in r.text)) for r in got)
    assert langid.predict(none, model, ["doc_id"]).count() == 0
    assert langid.fit(none) is None
    assert {r.lang_pred for r in langid.predict(odd, None, ["doc_id"]).collect()} == {"und"}


def test_codewords_differ():
    for n in (1, 2, 3, 7, 12):
        assert len(np.unique(langid.codewords(n), axis=0)) == n


# ---- quality ----


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert kneser_ney.classify(odd, labels).count() == len(ODD)
    assert kneser_ney.classify(none, labels).count() == 0
    untrusted = kneser_ney.classify(odd, labels.where("quality = 7")).collect()
    assert all(r.keep and r.perplexity is None for r in untrusted)


# ---- packing ----


def test_packing_round_trip(odd, none):
    packed = packing.pack_documents(odd, row=64)
    back = {}
    for r in packing.unpack_documents(packed).collect():
        back.setdefault(r.doc_id, []).append((r.token_start, bytes(r.raw)))
    whole = b"".join(raw for _, raw in sorted(back[None]))
    assert whole.decode() == ODD[5][1]
    assert [raw for _, raw in back[4]] == [b"one two three"] * 2
    for r in packed.collect():
        assert r.n_tokens == r.cu_seqlens[-1] <= 64 and len(r.input_ids) == 128
        position = np.frombuffer(r.position_ids, np.uint16)
        assert all((position[a:b] == np.arange(b - a)).all() for a, b in zip(r.cu_seqlens, r.cu_seqlens[1:], strict=False))
    assert packing.pack_documents(none).count() == 0


def test_best_fit_decreasing_equals_plain_search():
    rng = np.random.default_rng(2)
    for _ in range(20):
        lengths = rng.integers(1, 33, 60)
        plain = []
        for n in sorted(lengths.tolist(), reverse=True):
            fits = [i for i, c in enumerate(plain) if c >= n]
            if fits:
                plain[min(fits, key=lambda i: plain[i])] -= n
            else:
                plain.append(32 - n)
        assert len(packing.pack(lengths, 32)) == len(plain)


# ---- mixing ----


def test_sainte_lague_equals_plain_quotients():
    rng = random.Random(4)
    for _ in range(30):
        votes = [rng.randint(0, 1000) for _ in range(6)]
        seats = rng.randint(0, 60)
        got = [0] * 6
        for _ in range(seats if sum(votes) else 0):
            got[max(range(6), key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.sainte_lague([float(v) for v in votes], seats) == got


def test_mixing(spark, odd, none):
    rows = [(i, "w " * (i % 40), ("a", "b", "c", None)[i % 10 and i % 4]) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA + ", source string")
    got = mixing.mix_plan(docs, keep=("source",), block=16).collect()
    assert sorted(r.doc_id for r in got) == list(range(400))
    for s in ("a", "b", "c", None):
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 64
        assert all(0 <= r.taken <= 3 * r["size"] for r in of)
    again = mixing.mix_plan(docs.repartition(5), keep=("source",), block=16).collect()
    assert {(r.doc_id, r.taken) for r in got} == {(r.doc_id, r.taken) for r in again}
    assert mixing.mix_plan(odd).count() == len(ODD)
    assert mixing.mix_plan(none).count() == 0
    assert mixing.mix_documents(docs, block=16).columns == docs.columns


@pytest.mark.parametrize(("small", "large"), [((300, 10), (60, 1000)), ((1000, 10), (200, 10)), ((500, 7), (30, 60))])
@pytest.mark.parametrize("least_blocks", [256, 0.01])
def test_mixing_reaches_targets_over_many_shards(spark, monkeypatch, small, large, least_blocks):
    monkeypatch.setattr(mixing, "LEAST_BLOCKS", least_blocks, raising=False)
    rows = [(i, "w " * n, s) for s, (k, n) in (("a", small), ("b", large)) for i in range(k)]
    docs = spark.createDataFrame(rows, SCHEMA + ", source string")
    got = mixing.mix_plan(docs, keep=("source",), shard_words=100).collect()
    for s in ("a", "b"):
        of = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 128
        assert all(0 <= r.taken <= 3 * r["size"] for r in of)
        if least_blocks > 1:  # passes are spread evenly
            assert max(r.epochs for r in of) - min(r.epochs for r in of) <= 1


# ---- language model ----


def test_gru_learns_and_carries_state():
    shape = gru.Shape(8, np.array([0, 1, 3, 5]), 2)
    counts = np.array([10, 40, 40, 40, 40, 1, 1])
    ids = np.tile(np.array([1, 2, 3, 4], np.int32), 200)
    starts, lengths = np.arange(0, 800, 40), np.full(20, 40)
    p = gru.initial(shape, counts)
    before = gru.score(p, shape, ids, starts, lengths).sum()
    for _ in range(8):
        p = gru.train(p, shape, ids, starts, lengths, lanes=4)
    assert gru.score(p, shape, ids, starts, lengths).sum() > before * 0.6
    one = gru.score(p, shape, ids, starts, lengths, window=7)
    assert np.allclose(one, gru.score(p, shape, ids, starts, lengths, window=64), rtol=1e-4)


def test_lm_base_score(spark, odd, none):
    docs = odd.selectExpr("doc_id", "text", "row_id % 2 = 0 as train", "row_id as c", "words as word")
    got = lm.score_documents(docs, docs["train"], ("doc_id", "text"), lookup=2, words=2).collect()
    learn = [(t or "").lower().split() for i, (_, t) in enumerate(ODD) if i % 2 == 0]
    counts = {}
    for words in learn:
        for w in [*words, None]:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        tokens = [*(r.text or "").lower().split(), None]
        assert r.n_tokens == len(tokens) and r.train_tokens == n
        assert r.n_known == sum(t in counts for t in tokens)
        assert math.isclose(r.base_score, sum(math.log10((counts.get(t, 0) + 1) / (n + v + 1)) for t in tokens), rel_tol=1e-9)
        assert r.score < 0
    empty = none.selectExpr("doc_id", "text", "true as train")
    assert lm.score_documents(empty, empty["train"], ("doc_id",)).count() == 0


def test_words_outside_the_lookup_are_counted_in_their_text():
    """Each of a text's other words once, with its number, so that no shuffle has to count them."""
    rare = pa.array([["q"], ["z", "y", "z"], [], ["y", "y", "y"], []], pa.list_(pa.string()))
    want = [{"z": 2, "y": 1}, {}, {"y": 3}, {}]
    for lists in (rare[1:], rare.take(pa.array([1, 2, 3, 4]))):
        words, times = lm.counted(lists)
        assert [dict(zip(x, n, strict=True)) for x, n in zip(words.to_pylist(), times.to_pylist(), strict=True)] == want
    assert [x.to_pylist() for x in lm.counted(rare[:0])] == [[], []]


def shards_of(monkeypatch, docs, **options):
    """(row, shard, words) of what the network is trained on, and the number of shards."""

    class Dealt(Exception):
        pass

    def stop(dealt, vocabulary, rounds, n_shards):
        raise Dealt([tuple(r) for r in dealt.selectExpr("k0", "shard", "size(split(text, ' '))").collect()], n_shards)

    monkeypatch.setattr(lm, "train_rounds", stop)
    with pytest.raises(Dealt) as found:
        lm.score_documents(docs, docs["train"], ("doc_id",), **options)
    return found.value.args


def test_lm_trains_on_every_training_document(spark, monkeypatch):
    docs = spark.range(2000).selectExpr("id as doc_id", "concat(id, repeat(' word', 999)) as text", "id % 7 != 2 as train")
    rows, n_shards = shards_of(monkeypatch, docs)
    assert sorted(r[0] for r in rows) == [i for i in range(2000) if i % 7 != 2]
    assert n_shards == math.ceil(len(rows) * 1001 / lm.SHARD_TOKENS)


def test_lm_deals_copies_to_all_shards(spark, monkeypatch):
    text = "case when id % 3 = 0 then repeat('copy ', 299) || 'copy' when id % 3 = 1 then concat(id, repeat(' word', 299)) end as text"
    docs = spark.range(9000).selectExpr("id as doc_id", text, "true as train")
    rows, n_shards = shards_of(monkeypatch, docs, shard_tokens=50_000)
    assert n_shards == math.ceil((6000 * 301 + 3000) / 50_000)
    for k in range(3):  # copies, other texts, null texts
        sizes = np.bincount([r[1] for r in rows if r[0] % 3 == k], minlength=n_shards)
        assert sizes.sum() == 3000 and sizes.max() < 2 * 3000 / n_shards


# ---- chat ----


def test_escape_is_reversible():
    rng = random.Random(6)
    for _ in range(500):
        s = "".join(rng.choices("<|\\a>im_end\n", k=12))
        assert chat.unescape(chat.escape(s)) == s and "<|" not in chat.escape(s)
        assert chat.unescape_role(chat.escape_role(s)) == s and "\n" not in chat.escape_role(s)


def test_chat_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", said), (1, 1, "assistant", said), (1, 2, "assistant", None), (None, None, None, None), (2, 5, "assistant", "b"), (2, 1, "assistant", "a"), (2, 1, "assistant", "a")]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.digest_conversations(chat.format_turns(docs)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha(f"user\n{said}\nassistant\n{said}\nassistant\n\n")
    assert got[1].loss_sha256 == sha(said) and got[1].loss_chars == len(said)
    assert got[2].loss_sha256 == sha("aab") and got[2].n_turns == 3
    assert got[None].n_turns == 1
    placed = chat.place_turns(chat.format_turns(docs)).where("conv_id = 2").collect()
    assert sorted(r.token_start for r in placed)[0] == 0
    assert chat.digest_conversations(chat.format_turns(docs.limit(0))).count() == 0


# ---- archives ----


def test_archives(spark, tmp_path):
    rows = [(3, "http://a/ b", "<p>x</p>\r\n\r\nWARC/1.1"), (1, None, None), (2, "", ""), (5, "http://c", "<p>x</p>\r\n\r\nWARC/1.1"), (7, "http://d", "ü"), (None, "http://e", "ü")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    arcs = warc.build_arcs(pages.coalesce(1), archive_bytes=300)
    warc.convert_arcs(arcs, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read_warcs(spark, str(tmp_path / "w")).collect()}
    assert {k: (r.record_type, r.refers_to) for k, r in got.items()} == {1: ("response", None), 2: ("revisit", 1), 3: ("response", None), 5: ("revisit", 3), 7: ("response", None), None: ("revisit", 7)}
    assert got[5].payload_digest == warc.base32_sha1(rows[0][2].encode()) and got[7].payload_bytes == 2
    versions = {bytes(r.content).split(b"\n")[1][:1] for r in arcs.collect()}
    assert versions == {b"1", b"2"}


@pytest.mark.parametrize("squeeze", [False, True])
def test_binary_and_other_records_survive(spark, tmp_path, squeeze):
    """Latin-1 and zero bytes, a DNS answer, several files, string ids, gzipped archives."""
    payloads = {"a 1": "caf\xe9".encode("latin-1"), "b/ü": bytes(range(256)) * 3, "c": b"caf\xe9", "d": b"\0" * 10, "e": b""}
    dns = b"20010203040506\na.example. 60 IN A 127.0.0.1\n"
    data = warc.arc_header(2) + b"".join(warc.arc_record(2, 0, k, f"http://x/{k}", v) for k, v in payloads.items())
    data += warc.arc_line(2, 0, "dns:a.example", "text/dns", len(dns)) + dns + b"\n"
    arcs = spark.createDataFrame([(gzip.compress(data) if squeeze else data,)], "content binary")
    warc.convert_arcs(arcs, str(tmp_path / "w"), id_type="string", warc_bytes=200, broadcast_rows=0)
    got = {r.page_id: r for r in warc.read_warcs(spark, str(tmp_path / "w"), "string").collect()}
    assert {k: r.record_type for k, r in got.items()} == {"a 1": "response", "b/ü": "response", "c": "revisit", "d": "response", "e": "response", None: "resource"}
    assert got["c"].refers_to == "a 1" and got[None].url == "dns:a.example"
    assert all(got[k].payload_digest == warc.base32_sha1(v) and got[k].payload_bytes == len(v) for k, v in payloads.items())
    files = list((tmp_path / "w").rglob("*.txt"))
    assert len(files) > 1
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in files)
    assert raw.count(b"WARC-Type: warcinfo") == 1 and raw.count(b"WARC-Block-Digest: ") == 7
    assert payloads["b/ü"] in raw


def test_long_records_are_several_members(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 100)
    assert zlib.decompress(warc.member(b"abc"), 31) == b"abc" and warc.member(b"x" * 5000)[-1] == 0
    pages = spark.createDataFrame([(1, "u", "ab" * 5000)], "page_id long, url string, html string")
    warc.convert_arcs(warc.build_arcs(pages), str(tmp_path / "w"))
    assert [r.payload_bytes for r in warc.read_warcs(spark, str(tmp_path / "w")).collect()] == [10000]


def test_digests_are_base32():
    for data in (b"", b"abc", bytes(range(256))):
        assert warc.base32_sha1(data) == base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_wrong_lengths_are_refused():
    data = warc.arc_header(1) + warc.arc_record(1, 0, "1", "http://a", b"abc")
    assert len(list(warc.parse_arc(data))) == 2
    with pytest.raises(ValueError):
        list(warc.parse_arc(data[:-3]))


# ---- decontamination ----


def brute_hits(text, items):
    words = lambda t: "".join(c.lower() if c.isascii() and c.isalnum() else c if ord(c) > 127 else " " for c in t or "").split()
    w, hit, ids = words(text), set(), set()
    for name, t in items:
        x = words(t)
        n = min(10, len(x))
        for i in range(len(x) - n + 1 if n else 0):
            for j in range(len(w) - n + 1):
                if w[j : j + n] == x[i : i + n]:
                    hit |= set(range(j, j + n))
                    ids.add(name)
    return len(w), len(hit), len(ids)


@pytest.mark.parametrize("rows", [0, 100_000])
def test_decontamination_equals_brute_force(spark, rows):
    rng = random.Random(8)
    pool = "a b c d".split()
    items = [(f"i{i}", " ".join(rng.choices(pool, k=k))) for i, k in enumerate((0, 1, 3, 7, 10, 11, 14))] + [("n", None), ("i9", "Ü ☃")]
    docs = [(i, " ".join(rng.choices(pool + ["e"], k=rng.randint(0, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "x ü. ☃ Ü ☃"), (93, items[6][1]), (93, items[6][1])]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id string, text string"), broadcast_rows=rows).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in got) == sorted((d, *brute_hits(t, items)) for d, t in docs)


def test_decontamination_of_nothing(spark, odd, none):
    items = none.selectExpr("'x' as item_id", "text")
    assert decontaminate.decontaminate(odd, items).where("contaminated").count() == 0
    assert decontaminate.clean_documents(odd, items).count() == len(ODD)
    assert decontaminate.decontaminate(none, items).count() == 0


# ---- media ----


def test_media_round_trip(odd, none):
    got = media.sniff_media(media.store_as_media(odd), "media", "declared_type", ["doc_id", "n_bytes"]).collect()
    assert len(got) == len(ODD) and all(r.valid and r.corrected for r in got)
    texts = sorted((t or "").encode() for _, t in ODD)
    assert sorted(bytes(r.data)[: r.n_bytes] for r in got) == texts
    assert all(len(r.data) % 576 == 0 and len(r.data) for r in got)
    assert media.store_as_media(none).count() == 0


def test_embedded_media_is_carved(spark):
    inner = media.to_media(b"z" * 576)
    rows = spark.createDataFrame([(b"junk" + inner + b"tail", "image/png"), (b"RIFF\xff\xff\xff\xffWAVE", "audio/wav"), (None, None), (b"", "x")], "content binary, declared string")
    found = media.sniff_media(rows, "content", "declared", []).collect()
    assert [(c.offset, c.length) for c in found[0].carved] == [(4, len(inner))]
    assert [r.valid for r in found] == [False] * 4 and found[2].media_type is None
