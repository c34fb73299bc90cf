"""Exact removal of repeated byte strings: a logarithmic family of suffix arrays behind a content-defined routing.

A window is ``length`` consecutive bytes of one document; a byte goes if a window over it also starts earlier.

1. Routing. The least hash among a window's k-grams is its anchor; equal windows have equal anchors. Consecutive windows
   with one anchor are a run. A run is described by two independent hashes of 64 bits over its first and last window
   (these overlap or touch, so they fix its bytes), not by its bytes. Equal runs of a task are collapsed before anything
   moves: all but the first are repeats as a whole. Runs with an anchor that only one run has are new; unless
   they hold a window twice (periodic text), they are dropped.
2. Groups. One shuffle by anchor finds, of equal runs, the first; the others are repeats as a whole. Anchors left with
   several different runs, and periodic runs, are contested, and only those runs' bytes are fetched.
3. Suffix arrays. A task takes the runs of many contested anchors in document order, batch by batch: a batch's windows
   are sorted (its suffix array, at the positions that the routing sent here), merge-scanned against every level of the
   index for matches of full length, and become a new level; levels of equal size merge, so there are O(log n).
   A window has some thirty times the bytes that the next one adds to a run, so a task holds runs as bytes and takes
   windows in parts by some of their bytes, one index after another: equal windows are in one part.
4. Hot anchors (a line that a third of all documents hold has as many different contexts) are broken into single
   windows, each routed by its own hash; equal ones collapse, so no task gets the group. Anchors found hot on a sample are broken
   up at once; any that turns out hot when counted is broken up then. Either way gives the same result.
5. Repeats are gathered by document and cut out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, forget, same_row, small_batches, stored
from .hashing import BYTE, MUL, PLACE, U, mix

LENGTH, GRAM = 100, 20
#: Longest run, in windows: first and last window then still touch.
RUN = LENGTH
#: Bytes of documents that hot anchors are looked for on, about, and how many different runs of an anchor there make it hot.
SAMPLE_BYTES, SAMPLE_HOT = 50_000_000, 100
#: Different runs from which a counted anchor is hot; fewer are about a megabyte, which one task takes.
HOT = 8192
#: Bytes of runs that one suffix index task takes, about; windows that its index holds at a time, about, and that a batch has.
TASK_BYTES, PART_WINDOWS, BATCH_WINDOWS = 2_000_000, 1 << 16, 1 << 13
#: Document ids up to which the set of documents with contested runs is broadcast.
BROADCAST_ROWS = 200_000
#: Windows of a text that are hashed at a time, and run descriptions that a task collapses at a time.
SLICE, FLUSH_ROWS = 1 << 17, 150_000

STEP = U(0x9E3779B97F4A7C15)
BACK = U(pow(int(STEP), -1, 2**64))


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """STEP**i and STEP**-i for the places of a slice."""
    up, down = np.full(SLICE + LENGTH, STEP, U), np.full(SLICE + LENGTH, BACK, U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _pow(h: np.ndarray, gap: int, k: int) -> np.ndarray:
    """Hashes of strings of 2k bytes (or k + gap) from those of k bytes that start ``gap`` apart."""
    return h[: len(h) - gap] * MUL[k % 50] + h[gap:]


def second_hashes(raw: np.ndarray) -> np.ndarray:
    """A hash of every window that shares nothing with the first: random values of bytes, summed as a polynomial."""
    up, down = _powers()
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(PLACE[0][raw] * up[: len(raw)], out=sums[1:])
    n = len(raw) - LENGTH + 1
    return mix((sums[LENGTH:] - sums[:-LENGTH]) * down[:n])


def anchors_and_windows(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least gram hash of every window, and a hash of every window; both from the same doublings."""
    h, have = BYTE[raw], 1
    while have * 2 <= GRAM:
        h = _pow(h, have, have)
        h ^= h >> U(29)
        have *= 2
    gram = _pow(h, GRAM - have, GRAM) if have < GRAM else h.copy()
    gram *= U(0xBF58476D1CE4E5B9)
    gram ^= gram >> U(31)
    while have * 2 <= LENGTH:
        h = _pow(h, have, have)
        h ^= h >> U(29)
        have *= 2
    return _sliding_min(gram, LENGTH - GRAM + 1), _pow(h, LENGTH - have, LENGTH) if have < LENGTH else h


def _sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        h = np.minimum(h[: len(h) - have], h[have:])
        have *= 2
    return np.minimum(h[: len(h) - (width - have)], h[width - have :]) if have < width else h


def runs(raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a slice: run starts, run lengths in windows, anchors, both run hashes, and both hashes of every window."""
    anchor, window = anchors_and_windows(raw)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    n = np.diff(np.append(start, len(anchor)))
    if n.max() > RUN:  # periodic text: cut long runs
        pieces = -(-n // RUN)
        first = np.repeat(start, pieces)
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        n = np.minimum(np.repeat(n, pieces) - step * RUN, RUN)
        start = first + step * RUN
    other = second_hashes(raw)
    whole, whole2 = (mix(w[start] * MUL[51] + w[start + n - 1] * MUL[52] + n.astype(U)) for w in (window, other))
    return start, n, *(x.view(np.int64) for x in (anchor[start], whole, whole2, window, other))


def self_repeating(n: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Which runs hold a window twice."""
    out, ordered = np.zeros(len(n), bool), np.sort(window)
    if (ordered[1:] == ordered[:-1]).any():
        owner = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((window, owner))
        same = (window[order][1:] == window[order][:-1]) & (owner[order][1:] == owner[order][:-1])
        out[owner[order][1:][same]] = True
    return out


_ROWS = ["anchor", "run", "run2", "d", "start", "n", "inner"]
_SCHEMA = "anchor long, run long, run2 long, d long, start int, n int, inner int, marks array<struct<start:int,n:int>>"
_NO_ROWS = np.zeros((0, len(_ROWS)), np.int64)


def _collapsed(rows: np.ndarray) -> pd.DataFrame:
    """Runs of a task: the first of each kind as it is, and one more row per document with all its later ones.

    The latter repeat an earlier run of the task. Their ``marks`` are merged where they touch; a hash of the document
    stands for the anchor, which only spreads these rows.
    """
    rows = rows[np.lexsort(rows[:, 4::-1].T)]
    new = np.concatenate([[True], (rows[1:, :3] != rows[:-1, :3]).any(1)]) if len(rows) else np.zeros(0, bool)
    first = pd.DataFrame(rows[new], columns=_ROWS)
    first["marks"] = pd.Series([None] * len(first), dtype=object)
    later = rows[~new][:, 3:6]
    later = later[np.lexsort((later[:, 1], later[:, 0]))]
    if not len(later):
        return first
    d, start, n = later.T
    at = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (start[1:] != start[:-1] + n[:-1])]))
    spans = np.add.reduceat(n, at)
    d, start = d[at], start[at]
    own = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
    marks = [[{"start": s, "n": k} for s, k in zip(x.tolist(), y.tolist(), strict=True)] for x, y in zip(np.split(start, own[1:]), np.split(spans, own[1:]), strict=True)]
    told = pd.DataFrame({"anchor": mix(d[own].view(U)).view(np.int64), "run": 0, "run2": 0, "d": d[own], "start": 0, "n": 0, "inner": 0})
    told["marks"] = pd.Series(marks, dtype=object)
    return pd.concat([first, told], ignore_index=True)


def _slices(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces of a text with ``SLICE`` windows each, and where they start; any cut of runs gives the same result."""
    raw = np.frombuffer(data, np.uint8)
    for lo in range(0, len(raw) - LENGTH + 1, SLICE):
        yield lo, raw[lo : lo + SLICE + LENGTH - 1]


def _table(batch: pd.DataFrame, hot: np.ndarray) -> np.ndarray:
    """All runs of a batch as rows of ``_ROWS``; runs of hot anchors as single windows."""
    parts = [_NO_ROWS]
    for d, text in zip(batch["d"], batch["text"], strict=True):
        for lo, raw in _slices((text or "").encode("utf-8", "surrogatepass")):
            start, n, anchor, whole, whole2, window, other = runs(raw)
            inner = self_repeating(n, window).astype(np.int64)
            if len(hot):
                warm = np.isin(anchor, hot)
                if warm.any():
                    s, m = start[warm], n[warm]
                    pos = np.repeat(s - (np.cumsum(m) - m), m) + np.arange(m.sum())
                    parts.append(_single(window[pos], other[pos], d, lo + pos))
                    start, n, anchor, whole, whole2, inner = (x[~warm] for x in (start, n, anchor, whole, whole2, inner))
            parts.append(np.column_stack([anchor, whole, whole2, np.full(len(start), d, np.int64), lo + start, n, inner]))
    return np.concatenate(parts)


def _single(window: np.ndarray, other: np.ndarray, d: int, pos: np.ndarray) -> np.ndarray:
    """Single windows as runs of their own: routed by a hash of their whole content."""
    v = window.view(U)
    one = np.ones(len(v), np.int64)
    return np.column_stack([mix(v * MUL[53]).view(np.int64), mix(v + MUL[54]).view(np.int64), other, one * d, pos, one, 0 * one])


class SuffixIndex:
    """Sorted suffixes in levels of geometrically growing size. Only matches of full length count, so a suffix is kept as
    its first ``LENGTH`` bytes."""

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []

    def add(self, windows: np.ndarray) -> np.ndarray:
        """For each window of a batch, in document order: does it start earlier? The batch then joins the index."""
        order = np.argsort(windows, kind="stable")
        suffixes = windows[order]
        again = np.concatenate([[False], suffixes[1:] == suffixes[:-1]]) if len(suffixes) else np.zeros(0, bool)
        fresh = suffixes[~again]
        found = np.zeros(len(fresh), bool)
        for level in self.levels:
            at = np.searchsorted(level, fresh)
            inside = at < len(level)
            found[inside] |= level[at[inside]] == fresh[inside]
        repeat = np.empty(len(windows), bool)
        repeat[order] = again | np.repeat(found, np.diff(np.append(np.flatnonzero(~again), len(suffixes))))
        self.levels.append(fresh[~found])
        while len(self.levels) > 1 and len(self.levels[-1]) * 2 > len(self.levels[-2]):
            last = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], last]), kind="stable")
        return repeat


def _parts(data: bytes, at: np.ndarray) -> Iterator[np.ndarray]:
    """Numbers of the windows that start at ``at``, in order, in parts of about ``PART_WINDOWS``; equal windows are in one part."""
    parts = -(-len(at) // PART_WINDOWS)
    if parts < 2:
        yield np.arange(len(at))
        return
    words, key = np.ndarray(len(data) - 7, "<u8", data, strides=(1,)), np.zeros(len(at), U)
    for place in (0, 30, 61, LENGTH - 8):  # the ends and two places between, as many windows may begin alike
        key = mix(key + words[at + place])
    part = (key % U(parts)).astype(np.uint16)
    order = np.argsort(part, kind="stable").astype(np.int32)
    yield from np.split(order, np.cumsum(np.bincount(part, minlength=parts))[:-1])


def _scan_group(g: pd.DataFrame) -> pd.DataFrame:
    """Repeats among the runs of one task's anchors, found part by part, and batch by batch in document order."""
    g = g.sort_values(["d", "start"])
    n = g["n"].to_numpy(np.int64)
    if not len(n):
        return pd.DataFrame({"d": [], "start": [], "n": []})
    data, first = b"".join(g["bytes"]), np.cumsum(n) - n
    at = (np.arange(n.sum()) + np.repeat(np.arange(len(n)) * (LENGTH - 1), n)).astype(np.int32)
    text, repeat = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data, np.uint8), LENGTH), np.zeros(len(at), bool)
    for part in _parts(data, at):
        index = SuffixIndex()
        for lo in range(0, len(part), BATCH_WINDOWS):
            b = part[lo : lo + BATCH_WINDOWS]
            repeat[b] = index.add(text[at[b]].view(f"S{LENGTH}").ravel())
    again = np.flatnonzero(repeat)
    run = np.searchsorted(first, again, side="right") - 1
    d, pos = g["d"].to_numpy(np.int64)[run], g["start"].to_numpy(np.int64)[run] + again - first[run]
    begin = np.flatnonzero(np.diff(d, prepend=d[:1] - 1) | (np.diff(pos, prepend=pos[:1] - 1) != 1)) if len(d) else again
    return pd.DataFrame({"d": d[begin], "start": pos[begin], "n": np.diff(np.append(begin, len(d)))})


def _grouped(rows: DataFrame) -> DataFrame:
    """Rows by anchor: whether a run is the first of its kind, and how many kinds of run its anchor has."""
    told = F.col("marks").isNotNull()
    kind = Window.partitionBy("anchor", "told", "run", "run2").orderBy("d", "start")
    anchor = Window.partitionBy("anchor", "told")
    ranked = rows.withColumn("told", told).repartition("anchor", "told").select("*", F.row_number().over(kind).alias("rn"))
    ranked = ranked.select("*", F.sum((F.col("rn") == 1).cast("int")).over(anchor).alias("kinds"))
    return ranked.where("told or kinds > 1 or rn > 1 or inner = 1")


def _marks(rows: DataFrame) -> DataFrame:
    """(d, marks) of all runs that repeat an earlier one as a whole."""
    own = F.array(F.struct("start", "n"))
    return rows.where("told or rn > 1").select("d", F.when(F.col("told"), F.col("marks")).otherwise(own).alias("marks"))


def repeats(docs: DataFrame) -> DataFrame:
    """(d, marks): each mark (start, n) says that n consecutive windows of document d from byte ``start`` start earlier
    somewhere. A document has several rows, or none. ``docs``: d (unique), text."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    picked = docs if size <= SAMPLE_BYTES else docs.where(F.pmod(F.xxhash64("d", F.lit("hot")), F.lit(1_000_000)) < int(1e6 * SAMPLE_BYTES / size))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            t = _table(b, np.zeros(0, np.int64))
            yield pd.DataFrame(t[:, :2], columns=["anchor", "run"])

    often = picked.mapInPandas(count, "anchor long, run long").distinct().groupBy("anchor").agg(F.count("*").alias("m")).where(F.col("m") >= SAMPLE_HOT)
    # each hot anchor has SAMPLE_HOT different runs in SAMPLE_BYTES of text, so their number is bounded
    hot = np.array([r["anchor"] for r in often.select("anchor").collect()], np.int64)

    def describe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, rows = [], 0
        for b in batches:
            held.append(_table(b, hot))
            rows += len(held[-1])
            if rows >= FLUSH_ROWS:
                yield _collapsed(np.concatenate(held))
                held, rows = [], 0
        if held:
            yield _collapsed(np.concatenate(held))

    seen = stored(_grouped(docs.mapInPandas(describe, _SCHEMA)), "repeat-groups")
    marks = [_marks(seen)]
    contested = seen.where("not told and rn = 1 and (kinds > 1 or inner = 1)").select("anchor", "d", "start", "n", (F.col("kinds") > HOT).alias("hot"))
    per_doc = contested.groupBy("d").agg(F.collect_list(F.struct("anchor", "start", "n", "hot")).alias("c"))
    ids = contested.select("d").distinct()
    texts = docs.join(F.broadcast(ids), "d", "left_semi") if ids.count() <= BROADCAST_ROWS else docs
    volume = contested.where("not hot").agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows, singles = [], [_NO_ROWS]
            for d, text, c in zip(b["d"], b["text"], b["c"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                for r in c:
                    s, n = r["start"], r["n"]
                    if r["hot"]:
                        raw = np.frombuffer(data, np.uint8)[s : s + n + LENGTH - 1]
                        w = anchors_and_windows(raw)[1].view(np.int64), second_hashes(raw).view(np.int64)
                        singles.append(_single(*w, d, np.arange(s, s + n)))
                    else:
                        rows.append((r["anchor"], 0, 0, d, s, n, 0, None, data[s : s + n + LENGTH - 1]))
            yield pd.DataFrame(rows, columns=[*_ROWS, "marks", "bytes"])
            single = _collapsed(np.concatenate(singles))
            single["bytes"] = pd.Series([None] * len(single), dtype=object)
            yield single

    fetched = stored(texts.join(per_doc, "d").mapInPandas(fetch, _SCHEMA + ", bytes binary"), "repeat-runs")
    tasks = max(1, -(-int(volume) // TASK_BYTES))
    cold = fetched.where("bytes is not null").select("d", "start", "n", "bytes", F.pmod(F.xxhash64("anchor"), F.lit(tasks)).alias("task"))
    scanned = cold.groupBy("task").applyInPandas(_scan_group, "d long, start int, n int")
    marks.append(scanned.select("d", F.array(F.struct("start", "n")).alias("marks")))
    marks.append(_marks(_grouped(fetched.where("bytes is null").drop("bytes"))))
    out = stored(marks[0].unionByName(marks[1]).unionByName(marks[2]), "repeats")
    forget(seen, fetched)
    return out


def unique_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(d, text) with d unique and in document order, and what maps (doc_id, text) to d.

    Where doc_id is unique, d is doc_id. Otherwise rows that repeat id and text are one, and d numbers the rest by (id,
    hash of the text); only ids and hashes are ordered, in ranges.
    """
    rows = docs.select(same_row()[0].alias("k"), F.coalesce("text", F.lit("")).alias("text"))
    again = rows.groupBy("k").agg(F.count("*").alias("m")).where("m > 1").limit(1).count()
    if not again:
        return rows.withColumnRenamed("k", "d"), None
    ids = rows.select("k", F.xxhash64("text").alias("h")).distinct()
    ids = stored(ids.repartitionByRange("k", "h").withColumn("part", F.spark_partition_id()), "order")
    base = ids.groupBy("part").agg(F.count("*").alias("m")).withColumn("base", F.sum("m").over(Window.orderBy("part")) - F.col("m"))
    ids = ids.join(F.broadcast(base.drop("m")), "part").select("k", "h", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("k", "h"))).cast("long").alias("d"))
    ids = stored(ids, "order")
    one = rows.withColumn("h", F.xxhash64("text")).join(ids, ["k", "h"]).dropDuplicates(["d"])
    return one.select("d", "text"), ids


def removed_spans(docs: DataFrame) -> DataFrame:
    """(d, text, m): each document with its repeats, (start, n) of windows. A null ``m``: none."""
    # repeats are spread over many rows; they meet by document, and no document has more than its length allows
    m = repeats(docs).groupBy("d").agg(F.flatten(F.collect_list("marks")).alias("m"))
    return docs.join(m, "d", "left")


def kept_bytes(data: bytes, m) -> tuple[bytes, int, int]:
    """What stays of a document, the number of bytes removed and of maximal removed runs."""
    if m is None or not len(m):
        return data, 0, 0
    edge = np.zeros(len(data) + 1, np.int32)
    np.add.at(edge, [r["start"] for r in m], 1)
    np.add.at(edge, [r["start"] + r["n"] + LENGTH - 1 for r in m], -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), spans


def dedup_query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row for each distinct (doc_id, text).

    A null text is empty; empty and short texts have no windows and stay whole. Rows that repeat id and text are one
    document, so a repeated row does not remove itself; equal ids with different texts are ordered by a hash of the text. A
    null id comes first. Other columns are ignored; an empty table gives an empty result.
    """
    rows, ids = unique_rows(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, text, m in zip(b["d"], b["text"], b["m"], strict=True):
                data = text.encode("utf-8", "surrogatepass")
                kept, gone, spans = kept_bytes(data, m)
                out.append((d, len(data), gone, spans, hashlib.sha256(kept).hexdigest()))
            yield pd.DataFrame(out, columns=["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    out = removed_spans(rows).mapInPandas(cut, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if ids is not None:
        out = out.join(ids, "d").drop("d", "h").withColumnRenamed("k", "d")
    return out.select(F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def dedup_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated bytes cut out of text, and n_chars to match if there is such a column.

    A cut may fall inside a character; what is left of one is dropped. Rows stay, with an empty text if nothing is left;
    null texts become empty. Rows that repeat id and text are cut alike, by their first; equal ids with different texts
    are ordered by a hash of the text, and null ids come first. Other columns stay, whatever their names; an empty table
    gives an empty result.
    """
    rows, ids = unique_rows(docs)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            data = [t.encode("utf-8", "surrogatepass") for t in b["text"]]
            yield pd.DataFrame({"d": b["d"], "kept": [kept_bytes(x, m)[0].decode("utf-8", "ignore") for x, m in zip(data, b["m"], strict=True)]})

    m = removed_spans(rows).where("m is not null").mapInPandas(cut, "d long, kept string")
    k, h = same_row()
    whole = docs.select(F.struct("*").alias("row"), k.alias("k"), h.alias("h"))
    if ids is None:
        whole = whole.join(m.withColumnRenamed("d", "k"), "k", "left")
    else:
        whole = whole.join(m.join(ids, "d").select("k", "h", "kept"), ["k", "h"], "left")
    text = F.coalesce("kept", F.col("row").getField("text"), F.lit(""))
    new = {"text": text, "n_chars": F.char_length(text)}
    return whole.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col("row").getField(f.name)).alias(f.name) for f in docs.schema])
