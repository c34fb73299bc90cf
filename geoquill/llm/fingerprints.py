"""Document fingerprints by consistent weighted sampling, with DataFrame operations only.

A text's terms are its word pairs (the first word pairs with the start of the text), weighted by how often they occur.
For sample k and term x with weight w, hashes of (x, k) give four uniforms. The first two make r = -ln u1 - ln u2,
Gamma(2, 1), and b = ln u2 / (ln u1 + ln u2), uniform and independent of r; the others c = -ln u3 - ln u4, Gamma(2, 1).
Then t = floor(ln w / r + b) and a = c * exp(-r * (t - b + 1)); for w = 1 that is t = 0 and a = c * u1. The term with the
least a is the k-th sample, and (x, t) its identity: two texts share it with probability sum(min of weights) / sum(max
of weights), their generalised Jaccard similarity.

A fingerprint is ``SAMPLES`` identities of 32 bits, shown in hexadecimal. Texts without words have one term of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, forget, stored

SAMPLES = 32
_U24 = float(2**24)


def pair_hashes(text: Column) -> Column:
    """Sorted hashes of a text's word pairs."""
    words = F.filter(F.split(text, r"[\x00-\x20]+"), lambda w: w != "")
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.sort_array(
        F.when(F.size(hashed) == 0, F.array(F.xxhash64(F.lit("no words")))).otherwise(
            F.zip_with(hashed, F.concat(F.array(F.lit(0).cast("long")), F.slice(hashed, 1, F.size(hashed) - 1)), lambda a, b: F.xxhash64(a, b))
        )
    )


def weighted(sorted_hashes: str) -> Column:
    """Array of (x, w): the distinct values of a sorted array and how often each occurs."""
    h = F.col(sorted_hashes)
    n = F.size(h)
    firsts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.get(h, i - 1) != F.get(h, i - 2)))
    nexts = F.concat(F.slice(firsts, 2, F.size(firsts)), F.array(n + 1))
    return F.zip_with(firsts, nexts, lambda a, b: F.struct(F.get(h, a - 1).alias("x"), (b - a).alias("w")))


def _sample(k: int) -> Column:
    """The k-th sample of a row (x, lw) as one long: a on a monotone scale, then 32 bits that name (x, t); the least wins."""
    one = F.xxhash64(F.col("x"), F.lit(2 * k))
    two = F.xxhash64(F.col("x"), F.lit(2 * k + 1))
    u = lambda h, s: (F.shiftrightunsigned(h, s).bitwiseAND(F.lit(0xFFFFFF)).cast("double") + 0.5) / _U24
    c = -F.log(u(two, 0) * u(two, 24))
    l1, l2 = -F.log(u(one, 0)), -F.log(u(one, 24))
    r = l1 + l2
    t = F.floor((F.col("lw") + l2) / r)
    alone = F.col("lw") == 0.0
    a = F.when(alone, c * u(one, 0)).otherwise(c * F.exp(l2 - r * (t + 1)))
    scale = F.floor(F.sqrt(F.sqrt(a)) * float(2**28))
    name = F.when(alone, F.hash(F.col("x"), F.lit(0).cast("long"))).otherwise(F.hash(F.col("x"), t))
    return F.min(F.shiftleft(scale, 32).bitwiseOR(name.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))).alias(f"s{k}")


def signatures(terms: DataFrame, by: list[str], samples: int = SAMPLES) -> DataFrame:
    """``by``, fingerprint (binary, 4 bytes a sample): terms (x, w) of each group reduced to their samples in place."""
    rows = terms.withColumn("lw", F.log(F.col("w").cast("double")))
    got = rows.groupBy(*by).agg(*[_sample(k) for k in range(samples)])
    piece = [F.lpad(F.hex(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0") for k in range(samples)]
    return got.select(*by, F.unhex(F.concat(*piece)).alias("fingerprint"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an unbiased estimate of the generalised Jaccard similarity."""
    part = lambda c, k: F.substr(c, F.lit(4 * k + 1), F.lit(4))
    same = [(part(a, k) == part(b, k)).cast("double") for k in range(samples)]
    return sum(same[1:], same[0]) / F.lit(float(samples))


def neighbours(docs: DataFrame) -> DataFrame:
    """(d, h, n, next d and h, previous d, h and n) of the distinct documents in the order of (d, h), closed to a ring.

    Only ids and lengths are ordered. They lie in ranges; a range's last row is completed from the first of the next,
    and there are as many of those as ranges.
    """
    ids = docs.select("d", "h", F.char_length("text").alias("n")).dropDuplicates(["d", "h"])
    ids = stored(ids.repartitionByRange("d", "h").withColumn("part", F.spark_partition_id()), "ring")
    key, row = F.struct("d", "h"), F.struct("d", "h", "n")
    ends = ids.groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    over = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(over), F.first("first").over(whole)).alias("after"),
        F.coalesce(F.lag("last").over(over), F.last("last").over(whole)).alias("before"),
    )
    inside = Window.partitionBy("part").orderBy("d", "h")
    near = ids.select("*", F.lead(row).over(inside).alias("next"), F.lag(row).over(inside).alias("prev"))
    near = near.join(F.broadcast(ends), "part").select(
        "d", "h", "n", F.coalesce("next", "after").alias("next"), F.coalesce("prev", "before").alias("prev")
    )
    near = near.select("d", "h", "n", F.col("next.d").alias("nd"), F.col("next.h").alias("nh"), F.col("prev.d").alias("pd"), F.col("prev.h").alias("ph"), F.col("prev.n").alias("pn"))
    ring = stored(near, "ring")
    forget(ids)
    return ring


def edited_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n / 2) code points replaced by the first as many of the next document's. A null
    text is empty; rows that repeat id and text are one document; equal ids are ordered by a hash of the text, and a
    null id comes first. An empty table gives an empty result. Other columns are ignored.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("d", F.xxhash64("text").alias("h"), "text")
    ring = neighbours(rows)
    # text moves once by its own key and half of it once more, to the document before; the rest stays where that put it
    own = rows.join(ring, ["d", "h"])
    gift = own.select(F.col("pd").alias("d"), F.col("ph").alias("h"), F.substr("text", F.lit(1), F.floor(F.col("pn") / 2).cast("int")).alias("gift"))
    half = F.floor(F.col("n") / 2).cast("int")
    both = own.select("d", "h", "n", "text").join(gift, ["d", "h"])
    both = both.select("d", "h", "text", F.concat(F.substr("text", F.lit(1), F.col("n") - half), "gift").alias("edited"))
    two = F.array(
        F.struct(F.lit(False).alias("e"), F.unhex(F.lit("")).alias("sha"), F.col("text").alias("t")),
        F.struct(F.lit(True).alias("e"), F.unhex(F.sha2("edited", 256)).alias("sha"), F.col("edited").alias("t")),
    )
    texts = both.select("d", "h", F.inline(two)).select("d", "h", "e", "sha", pair_hashes(F.col("t")).alias("hs"))
    terms = texts.select("d", "h", "e", "sha", F.inline(weighted("hs")))
    made = signatures(terms, ["d", "h", "e", "sha"], samples)
    of = lambda c, e: F.max(F.when(F.col("e") == e, F.col(c)))
    made = made.groupBy("d", "h").agg(of("fingerprint", False).alias("own"), of("fingerprint", True).alias("edit"), of("sha", True).alias("sha"))
    made = stored(made.join(ring.select("d", "h", "n", "nd", "nh"), ["d", "h"]), "fingerprints")
    forget(ring)
    out = made.join(made.select(F.col("d").alias("nd"), F.col("h").alias("nh"), F.col("own").alias("after")), ["nd", "nh"])
    text = lambda c: F.lower(F.hex(F.col(c)))
    return out.select(
        F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), F.col("n").cast("long").alias("n_chars"), text("sha").alias("edited_sha256"),
        text("own").alias("fingerprint"), text("edit").alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edit"), samples).alias("near_edited"), likeness(F.col("own"), F.col("after"), samples).alias("near_next"),
    )
