"""Repeated and null ids, texts that hash alike, clashing columns, long texts; and plain versions of what SQL cannot say."""

import hashlib
import math
import random
import re
import struct
import tracemalloc
from pathlib import Path

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from geoquill.llm import boosting, chat_trees, common, decontaminate, fingerprints, hashing, jaccard_join, records, sentencepieces, suffix_dedup, token_counts, toxicity, transducers

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
#: Columns that operators might have used inside for themselves.
CLASH = "doc_id long, text string, kept string, _k long, _h string, _kept long, d long, th long, h long, k long, row string, key string, n_chars long, cid long, ids string, score double, ratio double"


def _clash(spark, rows):
    full = [(i, t, "kept", 7, "h", 8, 9, 10, 11, 12, "row", "key", len(t or ""), 13, "ids", 0.5, 0.25) for i, t in rows]
    return spark.createDataFrame(full, CLASH)


def _say(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def _even(n):
    s = "a"
    while len(s) < n:
        s += s.translate({97: 98, 98: 97})
    return s


def test_words_of_one_pattern_are_not_linked(spark):
    """Words whose polynomial hashes are equal modulo 2**64."""
    one = _even(2048)
    other = one.translate({97: 98, 98: 97})
    assert len({int(x) for x in hashing.word_hashes(f"{one} {other} {one[:1024]} {other[:1024]}")}) == 4
    assert hashing.word_hashes(one)[0] == hashing.word_hashes("x " + one)[1]
    docs = spark.createDataFrame([(1, one), (2, other), (3, f"x {one} y {other}"), (4, f"x {other} y {one}")], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}


def test_word_hashes_know_places(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice([1, 2, 63, 64, 65, 128, 200]))) for _ in range(3000)})
    got = hashing.word_hashes(" ".join(words))
    assert len(got) == len(words) == len(set(got.tolist()))
    assert hashing.word_hashes("ÄB c\tAbC\n")[-1] == hashing.word_hashes("abc")[0] and len(hashing.word_hashes(" \n")) == 0


def test_one_row_of_each_group(spark):
    x, y, z = _say(1, 30), _say(2, 30), _say(3, 30)
    rows = [(1, x), (5, x), (5, y), (5, y), (None, z), (7, z), (8, None), (9, ""), (9, "")]
    out = jaccard_join.one_of_each(_clash(spark, rows))
    assert out.columns == [c.split(" ")[0] for c in CLASH.split(", ")]
    got = sorted(((r.doc_id, r.text, r.kept, r.h) for r in out.collect()), key=str)
    assert got == sorted([(1, x, "kept", 11), (5, y, "kept", 11), (None, z, "kept", 11), (8, None, "kept", 11), (9, "", "kept", 11)], key=str)
    parts = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(_clash(spark, rows)).collect()}
    assert parts == {(1, 27, 1), (5, 27, 1), (5, 27, 5), (None, 27, None), (7, 27, None), (8, 0, 8), (9, 0, 9)}


def test_contamination_is_judged_by_row(spark):
    leak = "one two three four five six seven eight nine ten"
    rows = [(5, "clean text"), (5, "say " + leak), (None, "clean too"), (None, leak + " again"), (7, "other"), (7, "other"), (8, None)]
    items = spark.createDataFrame([(1, leak)], "item_id long, text string")
    kept = decontaminate.clean_documents(_clash(spark, rows), items)
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(5, "clean text"), (None, "clean too"), (7, "other"), (7, "other"), (8, None)], key=str)
    assert kept.columns == [c.split(" ")[0] for c in CLASH.split(", ")]
    got = {(r.doc_id, r.n_words, r.n_hit) for r in decontaminate.contamination(_clash(spark, rows), items).collect()}
    assert got == {(5, 2, 0), (5, 11, 10), (None, 2, 0), (None, 11, 10), (7, 1, 0), (8, 0, 0)}


def test_repeated_text_with_any_columns(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(150))
    rows = [(None, "n" + passage), (4, passage + "tail"), (4, "other " + passage), (6, None), (6, "")]
    out = suffix_dedup.dedup_texts(_clash(spark, rows))
    assert out.columns == [c.split(" ")[0] for c in CLASH.split(", ")]
    got = sorted(((r.doc_id, r.text, r.n_chars, r.kept, getattr(r, "_k"), r.h) for r in out.collect()), key=str)
    want = [(None, "n" + passage), (4, "tail"), (4, "other "), (6, ""), (6, "")]
    assert got == sorted([(i, t, len(t), "kept", 7, 11) for i, t in want], key=str)
    rows = {(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.dedup_query(_clash(spark, rows)).collect()}
    assert rows == {(None, 151, 0), (4, 154, 150), (4, 156, 150), (6, 0, 0)}


@pytest.mark.parametrize("piece", [37, 1 << 20])
def test_long_texts_in_slices(spark, monkeypatch, piece):
    """A text hashed in slices of any size gives what the whole gives."""
    monkeypatch.setattr(suffix_dedup, "SLICE", piece)
    monkeypatch.setattr(suffix_dedup, "FLUSH_ROWS", 50)
    suffix_dedup._powers.cache_clear()
    texts = [_say(8, 150), "x" * 700, _say(9, 60) + _say(8, 150)[200:600], _say(8, 150)[:300], "ab" * 150]
    seen, want = set(), {}
    for i, t in enumerate(texts):
        b, gone = t.encode(), bytearray(len(t))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        want[i] = (sum(gone), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.dedup_query(docs).collect()} == want
    suffix_dedup._powers.cache_clear()


@pytest.mark.parametrize("blank", [b"", b" " * 60])
def test_a_task_holds_runs_not_windows(monkeypatch, blank):
    """Repeats are those of a plain version, and what is held at once does not grow with a hundred bytes a window."""
    rng, rows = random.Random(5), []
    stems = [blank + bytes(rng.randrange(97, 101) for _ in range(199 - len(blank))) for _ in range(40)]
    for i in range(6000):
        x = bytearray(rng.choice(stems))
        x[rng.randrange(len(blank), len(x))] = 65 + rng.randrange(20)
        n = rng.randrange(1, 101)
        rows.append((i // 3, i % 3 * 1000, n, bytes(x[: n + 99])))
    seen, want = set(), set()
    for d, start, n, x in rows:
        for k in range(n):
            if x[k : k + 100] in seen:
                want.add((d, start + k))
            seen.add(x[k : k + 100])
    g = pd.DataFrame(rows, columns=["d", "start", "n", "bytes"]).sample(frac=1, random_state=1)
    windows, largest, add = int(g["n"].sum()), [], suffix_dedup.SuffixIndex.add

    def noted(index, x):
        out = add(index, x)
        largest.append(sum(level.nbytes for level in index.levels))
        return out

    monkeypatch.setattr(suffix_dedup.SuffixIndex, "add", noted)
    for size in (1 << 12, 1 << 16, 1 << 30):
        monkeypatch.setattr(suffix_dedup, "PART_WINDOWS", size)
        largest.clear()
        out = suffix_dedup._scan_group(g)
        assert sorted((d, s + k) for d, s, n in out.to_numpy(int).tolist() for k in range(n)) == sorted(want)
        assert max(largest) <= 100 * min(windows, 1.3 * size)
    monkeypatch.undo()
    tracemalloc.start()
    suffix_dedup._scan_group(g)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90 * windows
    assert not len(suffix_dedup._scan_group(g[:0])) and not len(suffix_dedup._scan_group(g[:1]))


def test_window_hashes_of_two_kinds():
    raw = np.frombuffer(_say(4, 400).encode(), np.uint8)
    first, second = suffix_dedup.anchors_and_windows(raw)[1], suffix_dedup.second_hashes(raw)
    windows = [raw[k : k + 100].tobytes() for k in range(len(raw) - 99)]
    assert len(set(windows)) == len(set(first.tolist())) == len(set(second.tolist()))
    part = raw[50:400]
    assert (suffix_dedup.second_hashes(part) == second[50:301]).all() and (suffix_dedup.anchors_and_windows(part)[1] == first[50:301]).all()


@pytest.mark.parametrize("size", [64, 200, 4096])
def test_pieces_at_any_chunk_size(spark, size):
    rows = [(None, "long " + _say(6, 400)), (2, "日本語 " * 90 + _say(7, 30)), (2, "a\n\n b" * 200), (3, None), (4, "x" * 900)]
    out = sentencepieces.encode(_clash(spark, rows), PIECES, size)
    whole = sentencepieces.pieces(PIECES).whole
    assert sorted(out.columns) == sorted(c.split(" ")[0] for c in CLASH.split(", "))
    got = sorted(((r.doc_id, list(r.ids)) for r in out.collect()), key=str)
    assert got == sorted([(i, whole.encode(t or "")) for i, t in rows], key=str)


def test_long_text_and_null_ids_everywhere(spark):
    """A text of more than a megabyte beside short ones, null ids, and one id with two texts."""
    long = _say(11, 220_000)
    rows = [(None, long), (1, "short text"), (1, "another text"), (2, None)]
    docs, tok = _clash(spark, rows), Tokenizer.from_file(BPE)
    n = {t: len(tok.encode(t or "", add_special_tokens=False).ids) for _, t in rows}
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.count_tokens(docs, BPE).collect()), key=str)
    assert got == sorted([(i, n[t]) for i, t in rows], key=str)
    folder, index = records.write_records(docs, BPE)
    back = sorted(((r.doc_id, r.n_tokens) for r in records.read_records(spark, folder, index).collect()), key=str)
    assert back == sorted([(i, n[t] + 1) for i, t in rows], key=str)
    hits = decontaminate.contamination(docs, spark.createDataFrame([(1, " ".join(long.split()[-12:]))], "item_id long, text string")).collect()
    assert sorted((r.n_words, r.n_hit) for r in hits) == [(0, 0), (2, 0), (2, 0), (220_000, 12)]
    prints = fingerprints.edited_fingerprints(docs).collect()
    assert sorted(r.n_chars for r in prints) == sorted(len(t or "") for _, t in rows)
    assert sorted(r.n_bytes for r in suffix_dedup.dedup_query(docs).collect()) == sorted(len(t or "") for _, t in rows)
    assert sorted((r.n_shingles > 1000, r.doc_id is None) for r in jaccard_join.jaccard_components(docs).collect()) == [(False, False)] * 3 + [(True, True)]
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    for query in (boosting.quality_query, toxicity.toxicity_query):
        got = query(docs, labels).collect()
        assert len(got) == 4 and all(0 <= r.score <= 1 for r in got) and [r.held_out for r in got if r.doc_id is None] == [True]


def test_samples_equal_a_plain_version(spark):
    """Consistent weighted sampling written out for one document: the identities of its least samples."""
    docs = spark.createDataFrame([(1, "a b a b a c d d d e"), (2, "a b")], "doc_id long, text string")
    made = {r.doc_id: r.fingerprint for r in fingerprints.edited_fingerprints(docs).collect()}
    terms = docs.where("doc_id = 1").select(fingerprints.pair_hashes(F.col("text")).alias("hs")).select(F.inline(fingerprints.weighted("hs"))).collect()
    weights = {r.x: r.w for r in terms}
    assert sorted(weights.values()) == [1, 1, 1, 2, 2, 2] or sum(weights.values()) == 10
    ks = range(fingerprints.SAMPLES)
    asked = spark.createDataFrame([(x,) for x in weights], "x long").select("x", *[F.xxhash64("x", F.lit(j)).alias(f"h{j}") for j in range(2 * len(ks))]).collect()
    uniform = lambda h, s: ((((h & (2**64 - 1)) >> s) & 0xFFFFFF) + 0.5) / 2**24
    want = []
    for k in ks:
        best = None
        for row in asked:
            one, two, lw = row[f"h{2 * k}"], row[f"h{2 * k + 1}"], math.log(weights[row.x])
            c = -math.log(uniform(two, 0) * uniform(two, 24))
            l1, l2 = -math.log(uniform(one, 0)), -math.log(uniform(one, 24))
            r, b = l1 + l2, l2 / (l1 + l2)
            t = math.floor(lw / r + b)
            best = min(best or (math.inf,), (c * math.exp(-r * (t - b + 1)), row.x, t))
        want.append(best[1:])
    names = spark.createDataFrame([(k, x, t) for k, (x, t) in enumerate(want)], "k int, x long, t long").select("k", F.hash("x", "t").alias("n")).orderBy("k").collect()
    assert made[1] == "".join(struct.pack(">i", r.n).hex() for r in names)


def test_forest_equals_plain_trees():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.fit(x, y)
    for row in rng.normal(size=(50, 5)):
        raw = forest.base
        for f, c, v in zip(forest.feature, forest.cut, forest.value, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > c[at] else 1)
            raw += v[at - len(f)]
        assert abs(1 / (1 + math.exp(-raw)) - forest.score(row[None])[0]) < 1e-9
    assert ((forest.score(x) > 0.5) == y).mean() > 0.97


def test_composed_machines_equal_their_cascade():
    parts = toxicity.machines()
    whole, rng = transducers.cascade(parts), random.Random(2)
    for _ in range(400):
        symbols = [rng.randrange(toxicity.CLASSES) for _ in range(rng.randrange(12))]
        stream, accepted = symbols, True
        for m in parts:
            stream, ok = m.run(stream)
            accepted &= ok
        assert whole.run(symbols) == (stream, accepted)


def test_lone_words_are_no_match():
    g = toxicity.Grammar({"fool": (3.0, False, False), "kill": (2.0, True, True)})
    assert g.clause("fool") == ([], 0.0) and g.clause('"fool"') == ([], 0.0) and g.clause("nothing here") == ([], 0.0)
    assert g.clause("a fool") == ([("plain", 3.0)], 0.0) and g.clause("kill fool")[1] == 2.0
    assert [m for m, _ in g.clause("you are not a fool but a fool")[0]] == ["negated", "plain"]
    assert [m for m, _ in g.clause('"you fool" you fool')[0]] == ["reported", "targeted"]
    assert g.score(["fool. fool! fool"])[0] == g.score(["fine"])[0] < g.score(["you fool"])[0]


def test_reply_trees_deep_wide_and_clashing(spark):
    rows = [(1, k, k - 1 if k else None, "user" if k % 2 == 0 else "assistant", f"t{k}", 1.0) for k in range(300)]
    rows += [(2, 0, None, "user", "q", 0.0)] + [(2, k, 0, "assistant", f"a{k}", float(k)) for k in range(1, 200)]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, role string, text string, score double").withColumns({"anc": F.lit(1), "dist": F.lit(2), "leaf": F.lit(3), "piece": F.lit("x")})
    paths = chat_trees.branches(table.select("tree", "node", "parent", "role", "text", "score"), keep=3)
    out = {(r.tree, r.branch_rank): (r.leaf, r.n) for r in chat_trees.format_branches(table.select("tree", "node", "role", "text"), paths).select("tree", "branch_rank", "leaf", F.size(chat_trees.read_back(F.col("formatted"))).alias("n")).collect()}
    assert out == {(1, 1): (299, 300), (2, 1): (199, 2), (2, 2): (198, 2), (2, 3): (197, 2)}
    talk = spark.createDataFrame([(1, 0, "user", "x", 5, 6, "p")], "conv_id long, turn long, role string, text string, node long, tree long, piece string")
    assert chat_trees.format_conversations(talk).count() == 1


def test_vocabularies_that_ask_for_more_are_refused():
    with pytest.raises(ValueError):
        token_counts.ByteBpe(public_tokenizers.path("word_bpe_49k.json"))


def test_scratch_tables_go(spark):
    with common.scratch(spark):
        table = common.stored(spark.range(3), "x")
        path = Path(table._scratch_path.removeprefix("file://"))
        assert table.count() == 3 and path.is_dir()
    assert not path.exists()


def test_lists_over_salts_equal_brute_force(spark, monkeypatch):
    """One shingle in very many sets, some similar, some not."""
    monkeypatch.setattr(jaccard_join, "LONG_LIST", 4)
    monkeypatch.setattr(jaccard_join, "SMALLEST_LARGE", 2)
    rng = random.Random(6)
    rows = []
    for g in range(12):
        base = [f"g{g}w{j}" for j in range(30)]
        for _ in range(6):
            rows.append((len(rows), " ".join(["common", *[w if rng.random() > 0.03 else f"z{rng.randrange(9)}" for w in base]])))
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 1, 80).collect()}
    sets, of = {i: frozenset(re.split(" ", t)) for i, t in rows}, {i: i for i, _ in rows}
    for _ in range(8):
        for a in sets:
            for b in sets:
                o = len(sets[a] & sets[b])
                if 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                    of[a] = of[b] = min(of[a], of[b])
    assert got == of
