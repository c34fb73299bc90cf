"""Benchmark decontamination by a positional inverted index, with DataFrame operations only.

1. Test items are cut into windows (phrases), each distinct one once.
2. The index: postings (term, document, positions) of the documents' words for every term that the tests use, written
   per task without a shuffle, so it is segmented as a search index is. Document frequencies come from the index.
3. Of each window the rarest terms are its probes. A posting also holds 16-bit hashes of the words beside it, so an entry
   whose neighbours contradict the window is passed over where it lies. The probes' posting lists, each shifted by the
   probe's offset, are intersected by collecting probes per (document, window, start). A start that every probe supports
   is a candidate.
4. Candidates meet the whole document, where all words of the window are compared.

Words are runs of A-Z, a-z, 0-9 and everything outside ASCII, with A-Z lower-cased.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, same_row, stored

WINDOW = 10
#: Rarest terms of a window whose lists are intersected.
PROBES = 3
#: Rows up to which a table made from the test set is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000
#: What separates words, and the letters that are lower-cased.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: str) -> Column:
    low = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    return F.filter(F.split(low, SEPARATORS), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, phrase): every ``size`` consecutive words of an item, or all of them if there are fewer, but not none."""
    w = items.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    last = F.greatest(F.size("w") - size + 1, F.lit(1))
    return w.select("item_id", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("w", i, size))).alias("phrase")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _beside(w: str) -> Column:
    """Array of (term, before, after) of a word array; the hash beside the first and the last word is null."""
    h = F.transform(w, lambda x: F.pmod(F.hash(x), F.lit(65536)) - 32768).cast("array<short>")
    none = F.array(F.lit(None).cast("short"))
    n = F.size(w) - 1
    parts = F.arrays_zip(F.col(w).alias("term"), F.concat(none, F.slice(h, F.lit(1), n)).alias("before"), F.concat(F.slice(h, F.lit(2), n), none).alias("after"))
    return F.when(F.size(w) > 0, parts)


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, pos, before, after) of the given terms, positions from 0. ``docs``: key, w (words).

    Each task writes its own segment; nothing is shuffled. A document's postings stand together, so its key costs
    next to nothing in the columnar file.
    """
    n = terms.count()
    rows = docs.select("key", F.posexplode(_beside("w")).alias("pos", "t")).select("key", "pos", "t.*").toDF("key", "pos", "term", "before", "after")
    return stored(rows.join(_small(terms, n), "term").select("term", "key", "pos", "before", "after"), "postings")


def phrase_matches(index: DataFrame, phrases: DataFrame, probes: int = PROBES) -> DataFrame:
    """Candidates (key, pid, start): where the rarest terms of a phrase all stand at their offsets.

    ``phrases``: pid, phrase. A phrase of ``probes`` words or fewer is matched in full by this alone.
    """
    n_phrases = phrases.count()
    df = stored(index.groupBy("term").agg(F.count("*").alias("df")), "postings-df")
    each = phrases.select("pid", F.posexplode(_beside("phrase")).alias("off", "t")).select("pid", "off", "t.*").toDF("pid", "off", "term", "b", "a")
    terms = each.join(_small(df, df.count()), "term")
    ranked = terms.groupBy("pid").agg(F.count("*").alias("known"), F.slice(F.sort_array(F.collect_list(F.struct("df", "off", "term", "b", "a"))), 1, probes).alias("p"))
    # a phrase with a term that no document has cannot occur
    whole = phrases.join(ranked, "pid").where(F.col("known") == F.size("phrase"))
    probe = stored(whole.select("pid", F.expr("shiftleft(1, size(p)) - 1").alias("need"), F.posexplode("p").alias("j", "t")).select("t.term", "pid", "t.off", "t.b", "t.a", F.expr("shiftleft(1, j)").alias("bit"), "need"), "probes")
    fits = lambda want, have: F.col(want).isNull() | F.col(want).eqNullSafe(F.col(have))
    hits = index.join(_small(probe, n_phrases * probes), "term").where(fits("b", "before") & fits("a", "after")).select("key", "pid", (F.col("pos") - F.col("off")).alias("start"), "bit", "need")
    held = hits.where("start >= 0").groupBy("key", "pid", "start").agg(F.bit_or("bit").alias("got"), F.max("need").alias("need"))
    found = stored(held.where("got = need").select("key", "pid", "start"), "candidates")
    forget(df, probe)
    return found


def near_matches(index: DataFrame, pairs: DataFrame, within: int) -> DataFrame:
    """Proximity: (key, pair_id) where terms a and b of ``pairs`` (pair_id, a, b) stand at most ``within`` words apart.

    Positions fall into bins of that width; b's are looked up in their own bin and both neighbours, so each list is
    read once and no list is paired with a whole list.
    """
    side = lambda c: index.join(pairs.select("pair_id", F.col(c).alias("term")), "term").select("pair_id", "key", "pos", F.floor(F.col("pos") / (within + 1)).alias("bin"))
    b = side("b").select("pair_id", "key", F.col("pos").alias("pos_b"), F.explode(F.array(F.col("bin") - 1, F.col("bin"), F.col("bin") + 1)).alias("bin")).distinct()
    return side("a").join(b, ["pair_id", "key", "bin"]).where((F.abs(F.col("pos") - F.col("pos_b")) <= within) & (F.col("pos") != F.col("pos_b"))).select("key", "pair_id").distinct()


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), one row for each distinct (doc_id, text).

    A null text has no words, so it is never hit; a null item has no windows. Rows that repeat id and text are one
    document; a null id is a document like any other. Empty tables give empty results or no hits. Other columns are
    ignored.
    """
    return _contamination(docs, items, size).drop("key")


def _contamination(docs: DataFrame, items: DataFrame, size: int) -> DataFrame:
    """:func:`contamination` with the key (d, h) of each row, for those who look rows up again."""
    d, h = same_row()
    keyed = docs.select("doc_id", F.struct(d.alias("d"), h.alias("h")).alias("key"), "text")
    win = stored(windows(items, size), "windows")
    phrases = stored(win.select("phrase").distinct().select(F.md5(F.to_json("phrase")).alias("pid"), "phrase"), "phrases")
    item_of = win.select("item_id", F.md5(F.to_json("phrase")).alias("pid"))
    terms = stored(phrases.select(F.explode("phrase").alias("term")).distinct(), "terms")
    index = build_index(keyed.select("key", words("text").alias("w")), terms)
    found = phrase_matches(index, phrases)
    forget(index, terms)
    starts = found.join(_small(phrases, phrases.count()), "pid").groupBy("key").agg(F.collect_set(F.struct("start", "pid", "phrase")).alias("c"))
    # the text moves to its candidates, not its words, which take more room
    checked = keyed.join(starts, "key", "left").select(
        "doc_id", "key", words("text").alias("w"), F.coalesce("c", F.array().cast(starts.schema["c"].dataType)).alias("c")
    )
    same = F.filter("c", lambda c: F.slice("w", c["start"] + 1, F.size(c["phrase"])) == c["phrase"])
    brief = F.transform(same, lambda c: F.struct(c["start"].alias("start"), c["pid"].alias("pid"), F.size(c["phrase"]).alias("len")))
    real = stored(checked.select("doc_id", "key", F.size("w").cast("long").alias("n_words"), brief.alias("c")).dropDuplicates(["key"]), "matches")
    forget(found, phrases)
    spans = F.array_distinct(F.transform("c", lambda c: F.struct(c["start"].alias("start"), c["len"].alias("len"))))
    hit = F.size(F.array_distinct(F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["start"] + s["len"] - 1)))))
    named = real.select("key", F.explode(F.array_distinct(F.col("c.pid"))).alias("pid")).join(_small(item_of, win.count()), "pid")
    named = named.groupBy("key").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    out = real.select("doc_id", "key", "n_words", hit.cast("long").alias("n_hit")).join(named, "key", "left")
    ids = F.sort_array(F.coalesce("ids", F.array().cast("array<string>")))
    return out.select(
        "key", "doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which any window of the items occurs; all columns and all other rows stay.

    Every row is judged by its own text: another row of its id, or another without an id, does not matter. Repeated rows
    stay or go together, a null text has no words and stays, and an empty table of either kind removes nothing.
    """
    found = _contamination(docs, items, size).where("contaminated").select("key")
    d, h = same_row()
    whole = docs.select(F.struct("*").alias("row"), F.struct(d.alias("d"), h.alias("h")).alias("key"))
    return whole.join(found.distinct(), "key", "left_anti").select("row.*")
