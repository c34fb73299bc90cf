"""The pipeline against a plain version of every stage, and the entry without the subpackage."""

import random
import re
import subprocess
import sys
from pathlib import Path

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

ROOT = Path(__file__).resolve().parents[2]


def _texts():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(3, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    good = [say(rng.randint(40, 90)) + "." for _ in range(60)]
    junk = [(say(6).upper() + "!! ") * 9 for _ in range(30)]
    leak, passage = say(14), say(30)
    good[5] = good[5] + " " + leak
    good[6] = good[6][:150] + " " + passage + " tail"
    good[7] = good[7] + " " + passage
    good[9] = good[8]
    good[10] = " ".join(w if k % 97 else "swapped" for k, w in enumerate((good[8] + " " + say(60)).split()))
    good[11] = good[10].replace("swapped", "other", 1)
    return [*good, *junk, None, ""], leak


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    texts, leak = _texts()
    root = tmp_path_factory.mktemp("sf")
    rows = [(i, t, "xx", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, leak), (2, "nothing of this kind")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def _near(docs, k=5, num=80):
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    of = {i: i for i in docs}
    for _ in range(3):
        for a in docs:
            for b in docs:
                o = len(sets[a] & sets[b])
                if sets[a] and sets[b] and 100 * o >= num * (len(sets[a]) + len(sets[b]) - o):
                    of[a] = of[b] = min(of[a], of[b])
    return {i: t for i, t in docs.items() if of[i] == i}


def _cut(docs):
    seen, out = set(), {}
    for i, t in sorted(docs.items()):
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(b[k : k + 100])
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


def test_pipeline(spark, folder):
    import corpus_pipeline

    texts, leak = _texts()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "repeated_text", "benchmark_leaks", "pieces"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id: r.text or "" for r in corpus_pipeline.quality(spark, docs, folder).collect()}
    assert {i for i in kept if i < 90} == set(range(60))
    want = _cut(_near(kept))
    assert 9 not in want and 11 not in want
    shingle = leak.split()[:10]
    want = {i: t for i, t in want.items() if " ".join(shingle) not in t}
    assert 5 not in want
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    sp = SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert {i: r.text for i, r in out.items()} == want
    assert all(list(r.ids) == sp.encode(r.text) and r.n_chars == len(r.text) and r.lang == "xx" for r in out.values())


def test_stages_on_empty_documents(spark, folder):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert "ids" in docs.columns


def test_entry_without_the_subpackage(tmp_path):
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "class No:\n    def find_spec(self, name, *a):\n        if name.startswith(('geoquill.llm', 'corpus_pipeline')): raise ImportError(name)\n"
        "sys.meta_path.insert(0, No())\nimport __spark_entry__ as e\nq = e.queries()\nassert q and not [k for k in q if k.startswith('op')]\nassert set(e.oracle_sql()) <= set(q)\n" % str(ROOT)
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)
