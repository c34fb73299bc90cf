"""The training-data operators on odd rows: nulls, empty and long texts, repeats, ties, empty tables, clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoquill.llm import boosting, chat_trees, decontaminate, fingerprints, jaccard_join, records, sentencepieces, suffix_dedup, token_counts, toxicity
from geoquill.llm.bpe import ByteBpe, prove_whole_tokens

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORDS = "alpha beta gamma delta river stone cloud ember frost maple cedar birch willow harbor lantern meadow".split()
SCHEMA = "doc_id long, text string, score string, d long, ids string, n long"


def _say(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


def _rows():
    rng = random.Random(5)
    base = [_say(rng, n) for n in (3, 1, 12, 14, 40, 200, 900)]
    near = [" ".join(w if rng.random() > 0.012 else "changed" for w in base[5].split()) for _ in range(6)]
    texts = [*base, base[4], base[5], *near, None, "", " \n ", "ünïcödé 日本 <|endoftext|> x" * 30, "ab" * 400, base[6] + " " + base[5], base[2] + " tail", base[3][:-4]]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    return [*rows, (0, base[0]), (0, base[0])]  # repeated rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in _rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts(docs, none):
    tok = Tokenizer.from_file(BPE)
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(docs, BPE).collect()}
    want = set()
    for i, t in _rows():
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.add((i, len((t or "").encode()), n, n > 512))
    assert got == want
    assert token_counts.count_tokens(none, BPE).count() == 0


def test_bpe_equals_library():
    tok, own = Tokenizer.from_file(BPE), ByteBpe(BPE, prove_whole_tokens(BPE))
    rng = random.Random(1)
    for _ in range(2000):
        t = "".join(rng.choice(" \n\t\x1c\x85　abé's日½.,<|endoftext|>$%") for _ in range(rng.randint(0, 50)))
        ids = tok.encode(t, add_special_tokens=False).ids
        assert own.ids(t).tolist() == ids and own.count(t) == len(ids)


def test_records(spark, docs, none):
    one = docs.dropDuplicates(["doc_id"])
    folder, index = records.write_records(one, BPE)
    got = records.read_records(spark, folder, index).orderBy("doc_id").collect()
    tok, at = Tokenizer.from_file(BPE), 0
    for r, (i, t) in zip(got, sorted(dict(_rows()).items()), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    some = index.orderBy(F.desc("doc_id")).limit(3).collect()
    back = records.read_at(folder, [(r.shard, r.offset, r.length) for r in some])
    assert [len(x) for x in back] == [r.n_tokens for r in some]
    folder, index = records.write_records(none, BPE)
    assert records.read_records(spark, folder, index).count() == 0
    folder, index = records.write_records(docs.where("doc_id = 0").unionByName(docs.where("doc_id = 3").withColumn("doc_id", F.lit(None).cast("long"))), BPE)
    assert [r.doc_id for r in records.read_records(spark, folder, index).orderBy("start").collect()] == [None, 0, 0, 0]
    data = bytearray(b"".join(records.frame([b"abc", b"", b"x" * 1000])))
    assert [p for run in records.unframe(bytes(data)) for p in run] == [b"abc", b"", b"x" * 1000]
    data[14] ^= 1
    with pytest.raises(ValueError):
        list(records.unframe(bytes(data)))
    assert records.crc32c_many([b"123456789"])[0] == 0xE3069283


def _windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))] if w else []


def test_decontamination(spark, docs, none):
    long = dict(_rows())[18].split()
    items = [(1, " ".join(long[20:45])), (2, "cedar1 nowhere"), (3, None), (4, "..."), (5, " ".join(long[30:41])), (6, "tail"), (7, None), (8, _rows()[2][1]), (8, _rows()[2][1])]
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id long, text string, w string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, bench).collect()}
    for i, t in dict(_rows()).items():
        w, _ = _windows(t)
        hit, named = set(), set()
        for item, text in items:
            for x in _windows(text)[1]:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        named.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(named), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
    assert len(got) == len(dict(_rows()))
    assert decontaminate.contamination(none, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0
    words = docs.where("doc_id in (6, 9)").select(F.col("doc_id").alias("key"), decontaminate.words("text").alias("w"))
    a, b = (dict(_rows())[6].split()[k] for k in (1, 3))
    index = decontaminate.build_index(words, spark.createDataFrame([(a,), (b,)], "term string"))
    pairs = spark.createDataFrame([(1, a, b)], "pair_id long, a string, b string")
    assert {r.key for r in decontaminate.near_matches(index, pairs, 2).collect()} == {6}
    assert decontaminate.near_matches(index, pairs, 1).count() == 0


def test_fingerprints(docs, none):
    out = fingerprints.edited_fingerprints(docs).collect()
    rows = sorted(dict(_rows()).items())
    assert len(out) == len(rows)
    got, true, near = {r.doc_id: r for r in out}, [], []
    terms = lambda t: Counter(zip(["^", *t.split()], t.split(), strict=False))
    for k, (i, t) in enumerate(rows):
        t, after = t or "", rows[(k + 1) % len(rows)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1
        if t.split():
            a, b = terms(t), terms(edited)
            both = set(a) | set(b)
            true.append(sum(min(a[x], b[x]) for x in both) / sum(max(a[x], b[x]) for x in both))
            near.append(got[i].near_edited)
    assert np.abs(np.array(true) - near).mean() < 0.12
    assert got[12].fingerprint == got[21].fingerprint and got[12].fingerprint != got[15].fingerprint
    assert fingerprints.edited_fingerprints(none).count() == 0
    assert fingerprints.edited_fingerprints(docs.where("doc_id = 3")).first().near_next == 1.0


def test_quality_and_toxicity(spark, docs, none):
    rng = random.Random(2)
    good, bad = [_say(rng, 30) + "." for _ in range(60)], ["$$$ " + _say(rng, 5).upper() + "!!!" * 9 for _ in range(60)]
    rude = [_say(rng, 10) + ". You are a wretch" + str(k) + ". " + _say(rng, 9) for k in range(60)]
    rude = [re.sub(r"wretch\d+", "wretchling", t) for t in rude]
    texts = [*good, *bad, *rude]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(not 60 <= i < 120), int(i >= 120)) for i in range(180)] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out, right in ((boosting.quality_query(table, labels), lambda i: not 60 <= i < 120), (toxicity.toxicity_query(table, labels), lambda i: i >= 120)):
        rows = out.collect()
        assert sum(r.predicted == right(r.doc_id) for r in rows) >= 175
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    for query in (boosting.quality_query, toxicity.toxicity_query):
        assert query(none, labels).count() == 0
        assert query(docs, labels.limit(0)).where("score between 0 and 1").count() == len(_rows())
    grammar = toxicity.Grammar({"fool": (3.0, False, False)})
    marks = [m for m, _ in grammar.clause("he said you fool")[0]], [m for m, _ in grammar.clause("you fools")[0]], [m for m, _ in grammar.clause("never a fool")[0]]
    assert marks == (["reported"], ["targeted"], ["negated"])
    forest = boosting.fit(np.array([[0.0], [0.0], [5.0], [5.0]] * 20), np.array([0, 0, 1, 1] * 20, float))
    s = forest.score(np.array([[0.0], [5.0]]))
    assert s[0] < 0.1 < 0.9 < s[1]


@pytest.mark.parametrize(("k", "num"), [(4, 85), (5, 80), (1, 85)])
def test_jaccard_join(docs, none, k, num):
    got = {r.doc_id: r for r in jaccard_join.jaccard_components(docs, k, num).collect()}
    sets = {}
    for i, t in dict(_rows()).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    of = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * o >= num * (len(sets[a]) + len(sets[b]) - o):
                    of[a] = of[b] = min(of[a], of[b])
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == {i: (len(s), of[i]) for i, s in sets.items()}
    assert jaccard_join.jaccard_components(none, k, num).count() == 0


def test_jaccard_small_sets(spark):
    rng = random.Random(7)
    pool = [f"w{i}" for i in range(40)]
    rows = []
    for g in range(40):
        core = rng.sample(pool, rng.randint(5, 20))
        for _ in range(5):
            t = [w for w in core if rng.random() > 0.05] + rng.sample(pool, rng.randint(0, 1))
            rows.append((len(rows), " ".join(t)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(table, 1, 85).collect()}
    sets, of = {i: frozenset(t.split()) for i, t in rows}, {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if sets[a] and sets[b] and of[a] != of[b] and 100 * o >= 85 * (len(sets[a]) + len(sets[b]) - o):
                    of[a] = of[b] = min(of[a], of[b])
                    changed = True
    assert got == of


def test_suffix_dedup(docs, none, monkeypatch):
    def brute():
        seen, want = set(), {}
        for i, t in sorted(dict(_rows()).items()):
            b = (t or "").encode()
            gone = bytearray(len(b))
            for k in range(len(b) - 99):
                if b[k : k + 100] in seen:
                    gone[k : k + 100] = b"\1" * 100
                seen.add(b[k : k + 100])
            spans = sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1]))
            want[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
        return want

    want = brute()
    for hot, sample in ((8192, 100), (1, 100), (8192, 2)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "SAMPLE_HOT", sample)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_query(docs).collect()}
        assert got == want
    assert suffix_dedup.dedup_query(none).count() == 0
    cut = {r.doc_id: r.text for r in suffix_dedup.dedup_texts(docs).collect()}
    assert cut[45] == "" and len(suffix_dedup.dedup_texts(docs).columns) == 6


def test_sentencepieces(docs, none):
    model = sentencepieces.pieces(PIECES)
    rng = random.Random(4)
    for k in range(200):
        t = "".join(rng.choice("aeiouths \n\té日😀 the" if k % 2 else "aeiouthsrnd") for _ in range(rng.randint(0, 500)))
        assert sentencepieces.encode_text(model, t, 64) == model.whole.encode(t)
    for size in (sentencepieces.CHUNK, 100):
        out = sentencepieces.decode(sentencepieces.encode(docs, PIECES, size), PIECES).collect()
        assert len(out) == len(_rows())
        for r in out:
            assert list(r.ids) == model.whole.encode(r.text or "") and r.decoded == (r.text or "")
        both = sentencepieces.encode(docs, PIECES, size, back=True).select("text", "decoded").collect()
        assert len(both) == len(_rows()) and all(r.decoded == (r.text or "") for r in both)
    assert sentencepieces.encode(none, PIECES).count() == 0


def test_chat_trees(spark):
    nodes = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "a\\<|im_end|>", 2.0), (1, 3, 1, "assistant", None, 1.0), (1, 4, 2, "us\ner%0A", "x\n", 0.5),
             (2, 7, 8, "user", "loop", 0.0), (2, 8, 7, "user", "loop", 0.0), (2, 9, 7, "user", "below a loop", 0.0), (3, 1, 99, None, "lone", None)]
    table = spark.createDataFrame(nodes, "tree long, node long, parent long, role string, text string, score double")
    out = chat_trees.format_branches(table, chat_trees.branches(table)).select("tree", "leaf", "branch_rank", chat_trees.read_back(F.col("formatted")).alias("t"), chat_trees.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    got = {(r.tree, r.leaf): (r.branch_rank, [(x.role, x.text) for x in r.t], r.loss) for r in out.collect()}
    assert got == {
        (1, 4): (1, [("user", "hi"), ("assistant", "a\\<|im_end|>"), ("us\ner%0A", "x\n")], "a\\<|im_end|>"),
        (1, 3): (2, [("user", "hi"), ("assistant", "")], ""),
        (3, 1): (1, [("", "lone")], ""),
    }
    assert {r.leaf for r in chat_trees.branches(table, keep=1).collect()} == {4, 1}
    talk = spark.createDataFrame([(None, 1, "user", "x"), (5, None, None, None), (5, 2, "assistant", "y"), (5, 2, "assistant", "y")], "conv_id long, turn long, role string, text string")
    rows = {r.conv_id: r.n for r in chat_trees.format_conversations(talk).select("conv_id", F.size(chat_trees.read_back(F.col("formatted"))).alias("n")).collect()}
    assert rows == {None: 1, 5: 3}
    assert chat_trees.format_conversations(talk.limit(0)).count() == 0
