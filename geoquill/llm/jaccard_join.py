"""Exact Jaccard similarity join of documents' word shingles, size-aware: subsets for small sets, lists for large ones.

1. Equal sets are one class, whoever holds them; from here on classes are joined. Words are hashed by tabulation, a
   shingle is 64 bits, and a set's name is two independent sums of 64 bits over its shingles.
2. Small sets (up to a boundary chosen by cost) enumerate, for each pair of sizes that can be similar, their subsets of
   exactly the overlap which these sizes need. A shared subset, named by 128 bits, proves a link.
3. Large sets are ordered rarest shingle first and enter the inverted lists of their prefix: two similar sets share a
   list. How rare a shingle is comes from a counting sketch over all documents; any order is right, a good one is fast.
4. Long lists are not paired off. Each first compares its members with one leader; whoever links is in one component
   with it, and after a few leaders a list lies inside one component, or nearly. Then members of different components
   are compared, all of them. A pair is dropped early only where a bound proves it: by sizes, by the positions of the
   shared shingle, or by parity bits, as two sets differ in at least as many shingles as in bits. Only the rest is
   compared in full. A long list is dealt over ``SALTS`` tasks wherever its entries move.
5. Links become components.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, forget, same_row, small_batches, stored
from .graph import components
from .hashing import MUL, U, mix, shingles, word_hashes

#: Counters of the frequency sketch, a fixed size that is broadcast (2 bytes each), and blocks it is summed in.
SKETCH_BITS, BLOCKS = 22, 64
#: Largest boundary between small and large sets that is considered.
SMALLEST_LARGE = 25
#: Members from which a list has leaders first, at most how many, and the pairs per entry from which the next is tried.
LONG_LIST, LEADER_ROUNDS, CROSS_FACTOR = 64, 4, 32.0
#: Tasks that the entries of one list are dealt over.
SALTS = 16
#: Words of 64 parity bits of a set.
PARITY = 8
#: Rows of ids up to which they are broadcast.
BROADCAST_ROWS = 200_000


_BITS = [f"x{j}" for j in range(PARITY)]


def least_overlap(s: int, t: int, num: int, den: int) -> int:
    """Smallest o with den * o >= num * (s + t - o)."""
    return -(-num * (s + t) // (num + den))


def size_pairs(most: int, num: int, den: int) -> list[tuple[int, int, int]]:
    """(s, t, o) of different sets with s <= t <= most that can be similar."""
    out = []
    for t in range(1, most + 1):
        for s in range(1, t + 1):
            o = least_overlap(s, t, num, den)
            if o <= s and not (s == t == o):
                out.append((s, t, o))
    return out


def _slots(h: np.ndarray) -> np.ndarray:
    """Counter of each shingle."""
    return (mix(h.view(U) + MUL[61]) >> U(64 - SKETCH_BITS)).astype(np.int64)


def frequency_sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Counters by hashed shingle, each document counting once; summed in steps of at most 64 arrays a task."""
    spark, width = docs.sparkSession, (1 << SKETCH_BITS) // BLOCKS

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for b in batches:
            sets = [shingles(word_hashes(t), k) for t in b["text"]]
            if sets:
                np.add.at(total, _slots(np.concatenate(sets)), np.uint32(1))
        part = TaskContext.get().partitionId()
        # a byte a counter: what a task counts beyond is among the commonest anyway, and only the order depends on it
        yield pd.DataFrame({"part": part, "block": range(BLOCKS), "n": [x.tobytes() for x in np.minimum(total, 255).astype(np.uint8).reshape(BLOCKS, width)]})

    def whole(x: bytes) -> np.ndarray:
        return np.frombuffer(x, np.uint8 if len(x) == width else np.uint32)

    def add(g: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([whole(x) for x in g["n"]], axis=0, dtype=np.uint32)
        return pd.DataFrame({"part": [int(g["part"].iloc[0]) // 64], "block": [int(g["block"].iloc[0])], "n": [total.tobytes()]})

    schema = "part int, block int, n binary"
    sums = stored(docs.select("text").mapInPandas(count, schema), "sketch")
    more = True
    while more:
        sums = stored(sums.groupBy("block", F.floor(F.col("part") / 64)).applyInPandas(add, schema), "sketch")
        more = (sums.agg(F.max("part")).first()[0] or 0) > 0
    out = np.zeros((BLOCKS, width), np.uint32)
    for r in sums.collect():  # a fixed 16 MB
        out[r["block"]] += whole(r["n"])
    return out.ravel()


def _class_id(s: np.ndarray) -> tuple[int, int]:
    """The name of a set: two independent sums of its mixed shingles, 64 bits each."""
    v, n = s.view(U), np.array([len(s)], U)
    one, two = (mix(mix(v + MUL[k]).sum(dtype=U, keepdims=True) + n * MUL[k - 5]) for k in (62, 63))
    return int(one.view(np.int64)[0]), int(two.view(np.int64)[0])


def _rarity(counts: np.ndarray) -> np.ndarray:
    """Counters on a logarithmic scale of 16 bits, which sorts in linear time and keeps the order at any size of corpus."""
    return np.minimum(np.log2(1.0 + counts) * 2048, 0xFFFF).astype(np.uint16)


def signatures(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(d, th, n, h1, h2, prefix, small): set size and name, rarest shingles, and the whole set where it is small."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_rarity(frequency_sketch(docs, k)))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        often = sketch.value
        for b in batches:
            n, names, prefix, small, bits = [], [], [], [], []
            for t in b["text"]:
                s = shingles(word_hashes(t), k)
                n.append(len(s))
                names.append(_class_id(s))
                p = len(s) - -(-num * len(s) // den) + 1
                prefix.append(s[np.argsort(often[_slots(s)], kind="stable")[:p]] if len(s) else s)
                small.append(s if len(s) < SMALLEST_LARGE else s[:0])
                odd = np.bincount((s.view(U) >> U(55)).astype(np.int64), minlength=64 * PARITY) & 1
                bits.append(np.packbits(odd.astype(np.uint8)).view(np.int64))
            one, two = zip(*names, strict=True) if names else ((), ())
            out = pd.DataFrame({"d": b["d"], "th": b["th"], "n": n, "h1": one, "h2": two, "prefix": prefix, "small": small})
            yield out.join(pd.DataFrame(np.array(bits, np.int64).reshape(-1, PARITY), columns=_BITS, index=out.index))

    schema = "d long, th long, n int, h1 long, h2 long, prefix array<long>, small array<long>, " + ", ".join(f"{x} long" for x in _BITS)
    return stored(docs.mapInPandas(sign, schema), "jaccard-signatures")


def boundary(classes: DataFrame, num: int, den: int) -> int:
    """Largest size handled by subsets: the one with the least estimated rows, from a histogram of small sizes.

    A small set costs its subsets; a large one its prefix, each entry counted three times (list, leader, comparison).
    """
    rows = classes.groupBy(F.least("n", F.lit(SMALLEST_LARGE)).alias("n")).agg(F.count("*").alias("c")).collect()
    have = {r["n"]: r["c"] for r in rows}
    pairs = size_pairs(SMALLEST_LARGE - 1, num, den)
    best, least = 0, math.inf
    for edge in range(SMALLEST_LARGE):
        cost = sum(math.comb(s, o) * have.get(s, 0) + (s < t) * math.comb(t, o) * have.get(t, 0) for s, t, o in pairs if t <= edge)
        lowest = -(-num * (edge + 1) // den)
        cost += sum(3 * c * (n - -(-num * n // den) + 1) for n, c in have.items() if lowest <= n < SMALLEST_LARGE)
        if cost < least:
            best, least = edge, cost
    return best


def subset_links(classes: DataFrame, edge: int, num: int, den: int) -> DataFrame:
    """(a, b): links among sets of at most ``edge`` shingles, each group of a shared subset joined as a star."""
    pairs = size_pairs(edge, num, den)

    def subsets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for cid, n, s in zip(b["cid"], b["n"], b["small"], strict=True):
                v = np.asarray(s, np.int64).view(U)
                both = np.stack([mix(v + MUL[57]), mix(v + MUL[54])])
                for lo, hi, o in pairs:
                    if n in (lo, hi):
                        picks = np.array(list(itertools.combinations(range(n), o)), np.int64).reshape(-1, o)
                        base = U(lo * 1000 + hi) * MUL[55:57, None]
                        one, two = mix(both[:, picks].sum(2, dtype=U) + base).view(np.int64).tolist()
                        rows += [(x, y, n == lo, n == hi, cid) for x, y in zip(one, two, strict=True)]
            yield pd.DataFrame(rows, columns=["k1", "k2", "low", "high", "cid"])

    rows = classes.where((F.col("n") <= edge) & (F.col("n") > 0)).select("cid", "n", "small").mapInPandas(subsets, "k1 long, k2 long, low boolean, high boolean, cid long")
    rows = stored(rows, "subsets")
    ends = rows.groupBy("k1", "k2").agg(
        F.min(F.when(F.col("low"), F.col("cid"))).alias("x"), F.min(F.when(F.col("high"), F.col("cid"))).alias("y"),
        F.max("cid").alias("last"), F.min("cid").alias("first"),
    ).where("x is not null and y is not null and first <> last")
    met = rows.join(ends, ["k1", "k2"])
    to = F.when(F.col("low") & F.col("high"), F.col("first")).when(F.col("low"), F.col("y")).otherwise(F.col("x"))
    links = stored(met.select(F.col("cid").alias("a"), to.alias("b")).where("a <> b").distinct(), "jaccard-links")
    forget(rows)
    return links


def _few(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def _bits(large: DataFrame, name: str, tail: str) -> DataFrame:
    return large.select(F.col("cid").alias(name), *[F.col(x).alias(x + tail) for x in _BITS])


def _bits_fit(na: str, nb: str, num: int, den: int):
    """Whether few enough bits differ; sets that differ in more shingles than that are not similar."""
    apart = sum((F.bit_count(F.col(x + "a").bitwiseXOR(F.col(x + "b"))) for x in _BITS[1:]), F.bit_count(F.col("x0a").bitwiseXOR(F.col("x0b"))))
    return apart * (num + den) <= (F.col(na) + F.col(nb)) * (den - num)


def verified(docs: DataFrame, large: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Sets are rebuilt only for documents in pairs."""
    left = stored(pairs, "jaccard-pairs")
    ids = stored(left.select(F.col("a").alias("cid")).unionByName(left.select(F.col("b").alias("cid"))).distinct().join(large.select("cid", "rep", "h1", "h2"), "cid"), "jaccard-active")

    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = ((c, (x, y), shingles(word_hashes(t), k)) for c, x, y, t in zip(b["cid"], b["h1"], b["h2"], b["text"], strict=True))
            yield pd.DataFrame([(c, s) for c, name, s in sets if _class_id(s) == name], columns=["cid", "s"])

    texts = docs.join(_few(ids), docs["d"] == ids["rep"]).select("cid", "h1", "h2", "text")
    sets = stored(texts.mapInPandas(rebuild, "cid long, s array<long>"), "jaccard-sets")
    with_b = left.join(sets.select(F.col("cid").alias("b"), F.col("s").alias("sb")), "b")
    both = with_b.join(sets.select(F.col("cid").alias("a"), F.col("s").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = stored(both.where(shared * den >= (F.size("sa") + F.size("sb") - shared) * num).select("a", "b"), "jaccard-links")
    forget(left, ids, sets)
    return links


def _labelled(lists: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Lists with the component of each member so far."""
    if not links:
        return lists.withColumn("c", F.col("cid"))
    of = components(_all(links)).select(F.col("v").alias("cid"), "c")
    return lists.join(of, "cid", "left").withColumn("c", F.coalesce("c", "cid"))


def _open(state: DataFrame, turn: int) -> DataFrame:
    """Lists with members of several components: sizes, their largest component, a leader, and every salt they have."""
    order = F.col("rep") if turn == 0 else F.xxhash64("cid", F.lit(turn))
    per = state.groupBy("token", "c").agg(F.count("*").alias("m"), F.min(F.struct(order.alias("o"), "cid", "n", "pos")).alias("leader"))
    out = per.groupBy("token").agg(
        F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("same"), F.count("*").alias("kinds"), F.max(F.struct("m", "c")).alias("major"), F.min("leader").alias("leader")
    )
    return out.where("kinds > 1")


def _salted(tokens: DataFrame) -> DataFrame:
    """A row for each task that entries of the list are dealt to."""
    return tokens.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(F.col("all") >= LONG_LIST, SALTS - 1).otherwise(0))))


def _lists(entries: DataFrame) -> DataFrame:
    """Entries of lists with two or more, and the list's length m. Only one count per token and salt meets in a task."""
    dealt = entries.withColumn("salt", F.pmod(F.xxhash64("cid"), F.lit(SALTS)).cast("int")).repartition("token", "salt")
    part = dealt.groupBy("token", "salt").agg(F.count("*").alias("own"))
    m = part.select("token", "salt", F.sum("own").over(Window.partitionBy("token")).alias("m")).where("m > 1")
    met = dealt.join(m, ["token", "salt"])
    return stored(met.withColumn("salt", F.when(F.col("m") >= LONG_LIST, F.col("salt")).otherwise(0)), "jaccard-lists")


def list_links(docs: DataFrame, classes: DataFrame, known: DataFrame | None, edge: int, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links among sets that are not both small, enough of them to connect every component."""
    lowest = -(-num * (edge + 1) // den)
    large = classes.where(F.col("n") >= max(1, lowest))
    entries = large.select("cid", "n", F.posexplode("prefix").alias("pos", "token"))
    lists = _lists(entries)

    def possible(nx, px, ny, py):
        """Sizes fit, and from the shared shingle on, if it is the first, enough may follow in both sets."""
        rest = F.least(nx - px, ny - py)
        return (F.least(nx, ny) * den >= F.greatest(nx, ny) * num) & (rest * (num + den) >= (nx + ny) * num)

    links = [known] if known is not None else []
    left, before = stored(lists.where(F.col("m") >= LONG_LIST).join(large.select("cid", "rep"), "cid"), "jaccard-long"), math.inf
    for turn in range(LEADER_ROUNDS):
        if left.isEmpty():
            break
        state = _labelled(left, links)
        cross = (F.col("all") * F.col("all") - F.col("same")) / 2
        tokens = stored(_open(state, turn).where(cross > CROSS_FACTOR * F.col("all")), "jaccard-open")
        now = tokens.agg(F.sum(cross)).first()[0] or 0
        if not now or now > before / 2:  # nothing left that a leader would help with
            break
        before = now
        rows = state.join(_salted(tokens), ["token", "salt"])
        pairs = rows.where((F.col("leader.cid") != F.col("cid")) & possible(F.col("leader.n"), F.col("leader.pos"), F.col("n"), F.col("pos")))
        pairs = pairs.select(F.col("leader.cid").alias("a"), F.col("leader.n").alias("na"), F.col("cid").alias("b"), F.col("n").alias("nb")).distinct()
        pairs = pairs.join(_bits(large, "a", "a"), "a").join(_bits(large, "b", "b"), "b").where(_bits_fit("na", "nb", num, den)).select("a", "b")
        links.append(verified(docs, large, pairs, k, num, den))
        again = stored(left.join(_salted(tokens).select("token", "salt"), ["token", "salt"]), "jaccard-long")
        forget(left, tokens)
        left = again
    forget(left)
    state = stored(_labelled(lists, links), "jaccard-state")
    forget(lists)
    still = _salted(_open(state, 1).select("token", "all", F.col("major.c").alias("most")))
    rows = state.join(still, ["token", "salt"]).join(large.select("cid", *_BITS), "cid")
    rows = stored(rows.select("token", "salt", "all", "cid", "n", "pos", "c", (F.col("c") == F.col("most")).alias("main"), *_BITS), "jaccard-cross")
    side = lambda t: [F.col(x).alias(x + t) for x in ("n", "pos", "c", "main", *_BITS)]
    # who is not in a list's largest component meets every entry of it, in each of the tasks they are dealt over
    few = _salted(rows.where("not main").select("token", "all", F.col("cid").alias("a"), *side("a")))
    every = rows.select("token", "salt", F.col("cid").alias("b"), *side("b"))
    fit = possible(F.col("na"), F.col("posa"), F.col("nb"), F.col("posb")) & _bits_fit("na", "nb", num, den)
    meet = few.join(every, ["token", "salt"]).where((F.col("ca") != F.col("cb")) & (F.col("mainb") | (F.col("a") < F.col("b"))) & fit)
    pairs = meet.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links.append(verified(docs, large, pairs, k, num, den))
    forget(state, rows)
    return _all(links)


def _all(links: list[DataFrame]) -> DataFrame:
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def _classified(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(d, th, n, cid, least): every row with its class and its component's least (rep, cid). Both are null of an empty set."""
    small_batches(docs.sparkSession)
    d, th = same_row()
    docs = docs.select(d.alias("d"), th.alias("th"), "text")
    signed = signatures(docs, k, num, den)
    full = signed.where("n > 0")
    # a class gets a number when its table is written; its name of 128 bits leads there
    classes = full.groupBy("h1", "h2").agg(F.min("d").alias("rep"), F.max("n").alias("n"))
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    one = full.dropDuplicates(["h1", "h2", "d"]).join(classes.select("cid", "h1", "h2", F.col("rep").alias("d")), ["h1", "h2", "d"])
    shape = stored(one.select("cid", "h1", "h2", F.col("d").alias("rep"), "n", "prefix", "small", *_BITS), "jaccard-shapes")
    members = stored(signed.select("d", "th", "n", "h1", "h2"), "jaccard-documents")
    forget(signed)
    edge = boundary(shape, num, den)
    small = subset_links(shape, edge, num, den) if edge else None
    links = list_links(docs, shape, small, edge, k, num, den)
    forget(shape)
    of = components(links)
    named = classes.join(of.select(F.col("v").alias("cid"), "c"), "cid", "left").withColumn("c", F.coalesce("c", "cid"))
    least = named.groupBy("c").agg(F.min(F.struct("rep", "cid")).alias("least"))
    named = named.join(least, "c").select("h1", "h2", "cid", "least")
    out = members.where("n > 0").join(named, ["h1", "h2"]).select("d", "th", "n", "cid", "least")
    none = members.where("n = 0").select("d", "th", "n", F.lit(None).cast("long").alias("cid"), F.lit(None).cast(out.schema["least"].dataType).alias("least"))
    return out.unionByName(none)


def jaccard_components(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable by links) for every row of ``docs``.

    Two documents link when den * |intersection| >= num * |union|. A null or empty text, or one of white space, has an
    empty set and is linked with nothing, so it is its own component. Repeated rows are documents with equal sets; rows of
    one id with different texts are documents of their own. A null id is less than all others, and a component with one
    has a null component_id. Other columns are ignored; an empty table gives an empty result.
    """
    known = lambda c: F.when(c != NO_ID, c)
    component = F.when(F.col("n") > 0, F.col("least.rep")).otherwise(F.col("d"))
    return _classified(docs, k, num, den).select(known(F.col("d")).alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), known(component).alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each component: that of the least id, of equal ids the one of a least text hash.

    All columns stay, whatever their names. Documents without words are alone in theirs and stay. Rows that repeat id
    and text become one; a null id is less than all others. An empty table gives an empty result.
    """
    rows = _classified(docs, k, num, den)
    # of a component one class is kept, of that class the row of the least id; ids may repeat with different texts
    kept = rows.where((F.col("cid") == F.col("least.cid")) & (F.col("d") == F.col("least.rep"))).groupBy("d", "cid").agg(F.min("th").alias("th")).select("d", "th")
    kept = stored(kept.unionByName(rows.where("n = 0").select("d", "th").distinct()), "jaccard-kept")
    d, th = same_row()
    whole = docs.select(F.struct("*").alias("row"), d.alias("d"), th.alias("th"))
    again = whole.groupBy("d", "th").agg(F.count("*").alias("m")).where("m > 1").limit(1).count()
    out = whole.join(kept, ["d", "th"], "left_semi")
    return (out.dropDuplicates(["d", "th"]) if again else out).select("row.*")
