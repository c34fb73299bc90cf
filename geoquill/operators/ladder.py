"""Ranked search of addresses and names: every reading of a query is an ask, all asks are retrieved in one pass, and a query
keeps the hits of its first reading that has any.

Rungs: 0 the part behind the last comma as a region, 1 a bare postcode, 2 everything asked for (within the city that the
query ends in, where that explains it better), 3 without the unit, 4 without the postcode, 5 without both, 6 the text in the
postcode's city, 7 the text alone, 8 what stands before the first comma, 9 the Latin words of an address in two scripts.

``queries``: qid, q, country (codes behind commas, or null), and optionally street, housenumber, unit, city, state,
postcode, kind, lat and lng (a bias point). ``documents``: columns of :data:`.build.DOCUMENT` and alt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoquill.functions import geo, parse
from geoquill.functions import text as tx
from geoquill.sources.shared import kept

from . import search as se
from .build import ADDRESS, PLACE, POI, STREET
from .relational import first_by

#: Words that mean a direction or a street in an index, either form.
SYNONYMS = {a: [a, b] for p in ("n north", "s south", "e east", "w west", "ne northeast", "nw northwest", "se southeast", "sw southwest") for a, b in (p.split(), p.split()[::-1])} | {"st": ["st", "street"]}
#: Countries by what people write behind an address.
COUNTRY_WORDS = {
    "australia": "AU", "aus": "AU", "au": "AU", "new zealand": "NZ", "nzl": "NZ", "nz": "NZ", "united states": "US", "united states of america": "US", "usa": "US", "us": "US",
    "canada": "CA", "can": "CA", "united kingdom": "GB", "uk": "GB", "great britain": "GB", "gbr": "GB", "gb": "GB",
}
#: Score of a street where a street type was typed and its factor, factor of a spelling as typed, score of a known alias.
STREET_BONUS, STREET_FACTOR, SPELLING_FACTOR, ALIAS_SCORE = 10.0, 1.24, 1.1, 1000.0
#: How a document explains a query: its name and state, name and city, or name alone are all that was typed.
BY_STATE, BY_CITY, BY_NAME = 1, 2, 3
EXTRA = {"street": "string", "housenumber": "string", "unit": "string", "city": "string", "state": "string", "postcode": "string", "kind": "int", "lat": "double", "lng": "double"}
FIELDS = ["name", "alt", "locality", "state"]


def tokens(c: Column) -> Column:
    return tx.words(F.lower(tx.fold(F.coalesce(c, F.lit("")))))


def oversample(limit: Column, biased: Column, exact: Column) -> Column:
    """Candidates by plain score that are ranked anew: many where a point draws hits from anywhere."""
    return F.when(biased, F.least(F.greatest(limit * 30, F.lit(3_000)), F.lit(10_000))).when(exact, F.least(F.greatest(limit * 3, F.lit(100)), F.lit(150))).otherwise(F.least(limit * 3, F.lit(150)))


def country_suffix(queries: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``queries`` with a country at the end of q taken off and made the country: behind the last comma, or the shortest run
    of last words that names one. An explicit country that differs stays, and so does q. ``aliases``: name (lower case), cc."""
    q = F.trim("q")
    after = F.when(F.instr(q, ",") > 0, F.struct(F.lit(0).alias("o"), F.regexp_replace(q, r"\s*,[^,]*$", "").alias("body"), F.trim(F.substring_index(q, ",", -1)).alias("tail")))
    words = F.split(q, r"\s+")
    run = lambda n: F.struct(n.alias("o"), F.regexp_replace(F.array_join(F.slice(words, F.lit(1), F.size(words) - n), " "), r"[\s,]+$", "").alias("body"), F.array_join(F.slice(words, F.size(words) - n + 1, n), " ").alias("tail"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1))), run)
    cut = queries.select("qid", "country", F.explode(F.filter(F.concat(F.array(after), runs), lambda x: x.isNotNull() & (x["body"] != "") & (F.size(words) > 1))).alias("x")).select("qid", "country", "x.*")
    cut = cut.withColumn("tail", F.lower("tail")).withColumn("code", F.try_element_at(tx.mapping(COUNTRY_WORDS), F.col("tail")))
    if aliases is not None:
        cut = cut.join(aliases.select(F.col("name").alias("tail"), F.col("cc").alias("named")), "tail", "left").withColumn("code", F.coalesce("code", F.upper("named")))
    cut = cut.withColumn("code", F.coalesce("code", F.when(F.lower("country") == F.col("tail"), F.upper("country"))))
    found = first_by(cut.where("code is not null"), ["qid"], [F.col("o"), F.col("code")])
    codes = F.transform(F.split(F.upper("country"), ","), lambda c: F.trim(c))
    found = found.where(F.col("country").isNull() | F.array_contains(codes, F.col("code"))).select("qid", F.col("body").alias("_body"), F.col("code").alias("_code"))
    out = queries.join(found, "qid", "left")
    return out.withColumns({"q": F.coalesce("_body", "q"), "country": F.coalesce("_code", "country")}).drop("_body", "_code")


def two_readings(queries: DataFrame) -> DataFrame:
    """Queries with of (the query they stand for): "..., X, CA" without a country is asked in Canada and in California."""
    body = F.regexp_replace(F.trim("q"), r"(?i)\s+CA$", "")
    twice = F.col("country").isNull() & F.trim("q").rlike(r"(?i)\sCA$") & F.regexp_replace(body, ",+$", "").contains(",")
    own = F.struct(F.col("q").alias("q"), F.col("country").alias("country"), F.lit(0).alias("reading"))
    both = F.array(F.struct(body.alias("q"), F.lit("CA").alias("country"), F.lit(1).alias("reading")), F.struct(F.col("q").alias("q"), F.lit("US").alias("country"), F.lit(2).alias("reading")))
    rest = [c for c in queries.columns if c not in ("q", "country")]
    return queries.select(*rest, F.inline(F.when(twice, both).otherwise(F.array(own))))


def trailing_city(queries: DataFrame, documents: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(qid, body, city, city_importance): the last three to one words are exactly a town's name (rank 13 to 16), longest
    first; the most important town of that name. Else one word anywhere may be a known alias (alias, doc_id) of a place; of
    two letters only in capitals."""
    w = F.split(F.trim("q"), r"\s+")
    some = queries.where(F.col("q").isNotNull() & ~F.contains("q", F.lit(",")) & F.col("city").isNull() & F.col("street").isNull())
    cut = some.select("qid", "country", F.explode(F.filter(F.sequence(F.lit(1), F.lit(3)), lambda n: n < F.size(w))).alias("n"), w.alias("w"))
    cut = cut.select("qid", "country", "n", F.array_join(F.slice("w", F.lit(1), F.size("w") - F.col("n")), " ").alias("body"), tokens(F.array_join(F.slice("w", F.size("w") - F.col("n") + 1, F.col("n")), " ")).alias("key"))
    towns = documents.where((F.col("kind") == PLACE) & F.col("rank").between(13, 16)).select(tokens(F.col("name")).alias("key"), F.col("country").alias("cc"), F.col("name").alias("town"), "importance", "doc_id")
    met = cut.join(towns, "key").where(F.col("country").isNull() | (F.upper("country") == F.col("cc")))
    if aliases is not None:
        word = some.where(F.size(w) > 1).select("qid", "country", F.posexplode(w).alias("i", "word"), w.alias("w")).where((F.length("word") >= 3) | (F.col("word") == F.upper("word")))
        word = word.select("qid", "country", F.array_join(F.filter("w", lambda x, k: k != F.col("i")), " ").alias("body"), F.lower("word").alias("alias"))
        known = aliases.select(F.lower("alias").alias("alias"), "doc_id").join(documents.where(F.col("kind") == PLACE).select("doc_id", F.col("country").alias("cc"), F.col("name").alias("town"), "importance"), "doc_id")
        short = word.join(known, "alias").where(F.col("country").isNull() | (F.upper("country") == F.col("cc")))
        met = met.select("qid", "n", "body", "town", "importance", "doc_id").unionByName(short.select("qid", F.lit(0).alias("n"), "body", "town", "importance", "doc_id"))
    best = first_by(met, ["qid"], [F.desc("n"), F.desc("importance"), F.col("doc_id")])
    return best.select("qid", "body", F.col("town").alias("city"), F.col("importance").alias("city_importance"))


def _asks(queries: DataFrame, documents: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """(aid, qid, rung, scoped, tokens, and what is asked for): all readings of all queries, parsed together."""
    q = F.trim("q")
    last, head, tail = F.trim(F.substring_index(q, ",", -1)), F.regexp_replace(q, r"\s*,[^,]*$", ""), F.trim(F.substring_index(q, ",", 1))
    plain = F.col("state").isNull() & F.col("city").isNull() & F.contains(q, F.lit(",")) & (last != "") & (head != "")
    every = F.split(q, r"\s+")
    latin = F.filter(every, lambda t: t.rlike(r"^[\x00-\x7F]+$"))
    mixed = (F.size(latin) < F.size(every)) & (F.size(F.filter(latin, lambda t: t.rlike("[A-Za-z]"))) >= 2) & F.coalesce(F.get(latin, F.lit(0)).rlike("^[0-9]"), F.lit(False))
    text = lambda ok, rung, t, region: F.when(ok, F.struct(F.lit(rung).alias("rung"), F.lit(False).alias("scoped"), t.alias("t"), region.alias("region"), F.lit(None).cast("string").alias("town"), F.lit(0).alias("town_importance")))
    none = F.lit(None).cast("string")
    texts = F.array(text(plain, 0, head, last), text(F.lit(True), 2, F.coalesce(q, F.lit("")), none), text(F.contains(q, F.lit(",")) & (tail != ""), 8, tail, none), text(mixed, 9, F.array_join(latin, " "), none))
    rows = queries.select("*", F.inline(F.filter(texts, lambda x: x.isNotNull())))
    towns = trailing_city(queries, documents, aliases).withColumnsRenamed({"city": "town", "city_importance": "town_importance"})
    scoped = queries.join(towns, "qid").select(*queries.columns, F.lit(2).alias("rung"), F.lit(True).alias("scoped"), F.col("body").alias("t"), none.alias("region"), "town", F.col("town_importance").cast("int"))
    rows = rows.unionByName(scoped).withColumn("aid", F.struct("qid", "rung", "scoped"))
    parts = parse.freeform(rows.select("aid", "t", "country"), "aid", "t", "country").withColumnsRenamed({c: "p_" + c for c in ("house", "unit", "postcode", "state")})
    rows = rows.join(parts, "aid")
    rows = rows.select(
        "qid", "q", "country", "rung", "scoped", "street", "lat", "lng", "town_importance", F.col("kind").alias("q_kind"), tokens(F.col("rest")).alias("rest"),
        F.coalesce(F.lower("housenumber"), "p_house").alias("q_house"), F.coalesce(tx.unit_key(F.col("unit")), "p_unit").alias("q_unit"), tx.postcode(F.coalesce("postcode", "p_postcode")).alias("q_postcode"),
        F.coalesce("region", "state", "p_state").alias("q_state"), F.coalesce("town", "city").alias("q_city"), F.col("postcode").isNotNull().alias("firm"),
    )
    house, unit, code = F.col("q_house").isNotNull(), F.col("q_unit").isNotNull(), F.col("q_postcode").isNotNull()
    has_text = (F.size("rest") > 0) | F.col("street").isNotNull() | F.col("q_city").isNotNull() | F.col("q_state").isNotNull()
    loose = ~F.coalesce(F.col("q_kind").isin(ADDRESS, STREET), F.lit(False)) & ~F.col("firm")
    use = lambda ok, rung, h, p, u: F.when(ok, F.struct(F.lit(rung).alias("r"), F.lit(h).alias("use_house"), F.lit(p).alias("use_postcode"), F.lit(u).alias("use_unit")))
    strict = (F.col("rung") == 2) & ~F.col("scoped")
    own = F.struct(F.col("rung").alias("r"), (F.col("rung") != 8).alias("use_house"), (F.col("rung") != 8).alias("use_postcode"), (F.col("rung") != 8).alias("use_unit"))
    more = [use(strict & loose & house & unit, 3, True, True, False), use(strict & loose & house & code, 4, True, False, True), use(strict & loose & house & code & unit, 5, True, False, False),
            use(strict & ~F.col("firm") & ~house & code & has_text, 6, False, False, False), use(strict & ~F.col("firm") & (house | code) & has_text, 7, False, False, False)]
    rows = rows.select("*", F.inline(F.filter(F.array(own, *more), lambda x: x.isNotNull()))).drop("rung").withColumnRenamed("r", "rung")
    # the city of a postcode is that of its first address
    code_city = first_by(documents.where((F.col("kind") == ADDRESS) & F.col("postcode").isNotNull()), ["country", "postcode"], [F.col("doc_id")])
    code_city = code_city.select(F.col("country").alias("cc"), tx.postcode(F.col("postcode")).alias("q_postcode"), F.col("locality").alias("code_city"))
    sixth = rows.where("rung = 6").join(code_city, "q_postcode").where(F.col("country").isNull() | (F.upper("country") == F.col("cc")))
    sixth = first_by(sixth, ["qid"], [F.col("cc")]).withColumn("q_city", F.coalesce("q_city", "code_city")).drop("cc", "code_city")
    rows = rows.where("rung <> 6").unionByName(sixth)
    # what stands before the first comma is looked for near the place that follows it
    second = F.when(F.col("rung") == 8, tokens(F.split_part("q", F.lit(","), F.lit(2))))
    spots = documents.where(F.col("kind") == PLACE).select(tokens(F.col("name")).alias("key"), F.col("country").alias("cc"), F.col("lat").alias("s_lat"), F.col("lng").alias("s_lng"), "importance", "doc_id")
    near = rows.where((F.col("rung") == 8) & F.col("lat").isNull() & F.col("q_city").isNull()).select("qid", "country", second.alias("key")).join(spots, "key")
    near = first_by(near.where(F.col("country").isNull() | (F.upper("country") == F.col("cc"))), ["qid"], [F.desc("importance"), F.col("doc_id")]).select("qid", F.lit(8).alias("rung"), "s_lat", "s_lng")
    rows = rows.join(near, ["qid", "rung"], "left").withColumns({"lat": F.coalesce("lat", "s_lat"), "lng": F.coalesce("lng", "s_lng")}).drop("s_lat", "s_lng")
    return rows.withColumn("aid", F.struct("qid", "rung", "scoped"))


def _needs(asks: DataFrame) -> DataFrame:
    """(aid, rid, term, fields, in_score): what every hit must have, one row for each spelling of a word."""
    both = lambda t: F.coalesce(F.try_element_at(F.create_map(*[x for k, v in SYNONYMS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]), t), F.array(t))
    # a word as typed may stand in any field, its other spelling only in a name
    word = lambda t, i: F.transform(both(t), lambda s: F.struct(F.concat(F.lit("w"), t).alias("rid"), s.alias("term"), F.when(s == t, F.array(*map(F.lit, FIELDS))).otherwise(F.array(F.lit("name"))).alias("fields")))
    fixed = lambda c, tag, field: F.transform(F.array_distinct(tokens(F.col(c))), lambda t: F.struct(F.concat(F.lit(tag), t).alias("rid"), t.alias("term"), F.array(F.lit(field)).alias("fields")))
    parts = F.concat(F.flatten(F.transform(F.array_distinct("rest"), word)), fixed("street", "s", "name"), fixed("q_city", "c", "locality"), fixed("q_state", "r", "state"))
    return asks.select("aid", F.explode(parts).alias("x")).select("aid", "x.*")


def _ask_hits(asks: DataFrame, documents: DataFrame, index: DataFrame, lengths: DataFrame) -> DataFrame:
    """(aid, doc_id, score) of documents that have every word of an ask in a field where it may stand."""
    needs = _needs(asks)
    terms = needs.select("term").distinct()
    wanted = index.join(terms, "term", "left_semi")
    df = wanted.groupBy("country", "field", "term").agg(F.count("*").alias("df"))
    boost = F.create_map(*[F.lit(x) for kv in se.BOOSTS.items() for x in kv])
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.coalesce(F.try_element_at(boost, F.col("field")), F.lit(1.0))
    stats = df.join(lengths, ["country", "field"]).select("country", "field", "term", idf.alias("idf"), "avg")
    rows = wanted.join(stats, ["country", "field", "term"]).join(needs, "term").where(F.array_contains("fields", F.col("field")))
    part = F.col("idf") * F.col("tf") * (se.K1 + 1) / (F.col("tf") + se.K1 * (1 - se.B + se.B * F.col("dl") / F.col("avg")))
    got = rows.groupBy("aid", "doc_id").agg(F.sum(part).alias("score"), F.count_distinct("rid").alias("have"))
    need = needs.groupBy("aid").agg(F.count_distinct("rid").alias("need"))
    return got.join(need, "aid").where("have = need").select("aid", "doc_id", "score")


def _fits(h: str = "") -> Column:
    """Number, unit, postcode and kind as asked; addresses only where a number or postcode asks for one."""
    asked = F.col("use_house") & F.col("q_house").isNotNull()
    code = F.col("use_postcode") & F.col("q_postcode").isNotNull()
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    house = F.when(asked, (F.col("kind") == ADDRESS) & tx.house_matches(text("q_house"), text("housenumber"))).otherwise((F.col("kind") != ADDRESS) | code | F.coalesce(F.col("q_kind") == ADDRESS, F.lit(False)))
    unit = ~F.col("use_unit") | F.col("q_unit").isNull() | (tx.unit_key(text("unit")) == F.col("q_unit"))
    return house & unit & (~code | (tx.postcode(text("postcode")) == F.col("q_postcode"))) & (F.col("q_kind").isNull() | (F.col("kind") == F.col("q_kind")))


def grade(name: Column, locality: Column, state: Column, typed: Column) -> Column:
    """How a document explains what was typed: nothing else than its name, its name and city, its name and state, or not."""
    n = tokens(name)
    rest = F.slice(typed, F.size(n) + 1, F.greatest(F.size(typed) - F.size(n), F.lit(0)))
    starts = (F.size(rest) > 0) & tx.explains(typed, n)
    return F.when(n == typed, BY_NAME).when(starts & tx.explains(tokens(locality), rest), BY_CITY).when(starts & tx.explains(tokens(state), rest), BY_STATE).otherwise(0)


def ranking_key(kind: Column, exact: Column, importance: Column, km: Column, score: Column) -> Column:
    """(exact first, key): exact names by importance, near a bias point exact places nearest first, the rest by score."""
    near = exact & (kind == PLACE) & (km <= 150)
    return F.struct(F.when(km.isNull(), exact).otherwise(near).alias("exact"), F.when(km.isNull() & exact, importance.cast("double")).when(near, -km).otherwise(score).alias("key"))


def search(queries: DataFrame, documents: DataFrame, index: DataFrame, lengths: DataFrame, aliases: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """(qid, pos, doc_id, name, rung, score) of the best hits of each query. ``aliases``: (alias, doc_id) of known short names."""
    base = queries.select("qid", "q", "country", *[(F.col(c) if c in queries.columns else F.lit(None)).cast(t).alias(c) for c, t in EXTRA.items()])
    base = two_readings(country_suffix(base)).withColumn("of", F.col("qid")).withColumn("qid", F.struct("qid", "reading")).drop("reading")
    asks = kept(_asks(base.drop("of"), documents, aliases), "asks")
    found = _ask_hits(asks, documents, index, lengths)
    bare = base.where(F.col("q").rlike(r"^[A-Za-z0-9 -]{3,10}$") & F.col("q").rlike("[0-9]") & F.col("housenumber").isNull() & F.col("street").isNull())
    bare = bare.select("qid", "q", "country", F.lit(1).alias("rung"), F.lit(False).alias("scoped"), "lat", "lng", tx.postcode(F.col("q")).alias("q_postcode"))
    coded = documents.where((F.col("kind") == ADDRESS) & F.col("postcode").isNotNull()).withColumn("q_postcode", tx.postcode(F.col("postcode")))
    about = asks.select("aid", "qid", "q", "country", "rung", "scoped", "lat", "lng", "town_importance", "q_kind", "rest", "q_house", "q_unit", "q_postcode", "use_house", "use_postcode", "use_unit").withColumnsRenamed({"country": "cc", "lat": "b_lat", "lng": "b_lng"})
    rows = found.join(about, "aid").join(documents, "doc_id").where(_fits())
    lone = bare.withColumnsRenamed({"country": "cc", "lat": "b_lat", "lng": "b_lng"}).join(coded, "q_postcode").withColumn("score", F.lit(1.0))
    rows = rows.drop("aid").unionByName(lone, allowMissingColumns=True)
    codes = F.transform(F.split(F.upper("cc"), ","), lambda c: F.trim(c))
    rows = rows.where(F.col("cc").isNull() | F.array_contains(codes, F.col("country")))
    typed = tokens(F.col("q"))
    street_type = F.exists(F.coalesce("rest", F.array().cast("array<string>")), lambda t: t.isin(sorted({"street", "way", *tx.STREET_TYPES.values()} - {"junior", "senior"})))
    intent = street_type & ~(F.coalesce("use_house", F.lit(True)) & F.col("q_house").isNotNull()) & (F.col("kind") == STREET)
    score = F.when(intent, (F.col("score") + STREET_BONUS) * STREET_FACTOR).otherwise(F.col("score"))
    score = F.when((F.col("kind") == ADDRESS) & tx.whole_phrase(F.lower("q"), F.lower("name")), score * SPELLING_FACTOR).otherwise(score)
    rows = rows.withColumns({"score": score, "grade": grade(F.col("name"), F.col("locality"), F.col("state"), typed), "aliased": F.lit(False)})
    if aliases is not None:
        known = base.select("qid", F.lower(F.trim("q")).alias("alias")).join(aliases.select(F.lower("alias").alias("alias"), "doc_id"), "alias")
        names = documents.join(known, "doc_id").select("doc_id", "qid")
        rows = rows.drop("aliased").join(names.withColumn("aliased", F.lit(True)), ["qid", "doc_id"], "left").withColumn("aliased", F.coalesce("aliased", F.lit(False)))
        extra = names.join(base.select("qid", "q", F.col("country").alias("cc"), F.col("lat").alias("b_lat"), F.col("lng").alias("b_lng")), "qid").join(documents, "doc_id")
        extra = extra.select("*", F.lit(2).alias("rung"), F.lit(False).alias("scoped"), F.lit(ALIAS_SCORE).alias("score"), F.lit(BY_NAME).alias("grade"), F.lit(True).alias("aliased"))
        rows = rows.where("not (aliased and rung = 2)").unionByName(extra, allowMissingColumns=True)
    # the city reading of a query wins where it explains it, or where the plain one explains nothing
    w = Window.partitionBy("qid")
    strict = F.col("rung") == 2
    plain, inside = (F.coalesce(F.max(F.when(strict & (F.col("scoped") == s), F.col("grade"))).over(w), F.lit(-1)) for s in (False, True))
    city_named = F.coalesce(F.max(F.when(strict & ~F.col("scoped"), (F.col("kind") == PLACE) & F.exists(F.sequence(F.lit(1), F.lit(3)), lambda n: tokens(F.col("name")) == F.slice(typed, F.greatest(F.size(typed) - n + 1, F.lit(1)), n)))).over(w), F.lit(False))
    inner = (plain < BY_CITY) & ~city_named & ((inside >= BY_CITY) | ((plain < BY_STATE) & (inside >= 0)))
    rows = rows.withColumn("_inner", inner).where(~strict | (F.col("scoped") == F.col("_inner")))
    rows = rows.withColumn("_low", F.min("rung").over(w)).where("rung = _low")
    rows = kept(rows.drop("_low", "_inner"), "hits")
    exact_name = F.lower("name") == F.lower(F.trim("q"))
    exact = (F.col("kind").isin(PLACE, POI) & exact_name) | F.col("aliased")
    most = oversample(F.lit(limit), F.col("b_lat").isNotNull(), exact_name)
    first = Window.partitionBy("qid", "country").orderBy(F.desc("score"), "doc_id")
    rows = rows.withColumn("_k", F.row_number().over(first)).where(F.col("_k") <= most)
    km = geo.haversine(F.col("lat"), F.col("lng"), F.col("b_lat"), F.col("b_lng")) / 1000
    imp = F.col("importance")
    lifted = F.when(km.isNull(), se.prominence(F.col("score"), F.col("rank"), imp, F.col("kind") == POI)).otherwise(se.biased(F.col("score"), imp, km, (F.col("kind") == PLACE) & (imp > 0)))
    rows = rows.withColumns({"lifted": F.round(lifted, 4)}).withColumn("rk", ranking_key(F.col("kind"), exact, imp, km, F.col("lifted")))
    no_unit = F.col("q_unit").isNull() | ~F.coalesce("use_unit", F.lit(True))
    unitless = F.when(no_unit & (F.col("kind") == ADDRESS), F.coalesce("unit", F.lit("")) == "").otherwise(False)
    same = Window.partitionBy("qid", F.when((F.col("kind") == ADDRESS) & no_unit, F.struct(F.lower("name").alias("n"), "housenumber", "postcode", "lat", "lng")).otherwise(F.struct(F.col("doc_id").cast("string").alias("n"), "housenumber", "postcode", "lat", "lng"))).orderBy(F.desc(unitless), "doc_id")
    rows = rows.withColumn("_same", F.row_number().over(same)).where("_same = 1")
    # several countries are merged by seven keys, one country ranks by its own
    many = F.col("cc").isNull() | F.contains("cc", F.lit(","))
    seeks = F.trim("q").rlike("^[0-9]") & F.col("b_lat").isNull() & (F.col("kind") == ADDRESS)
    town = F.when(F.col("grade") == BY_CITY, F.coalesce("town_importance", F.lit(0))).when(F.col("scoped"), F.coalesce("town_importance", F.lit(0))).otherwise(0)
    merge = [F.when(many, seeks), F.when(many, F.col("grade")), F.when(many & (F.col("kind") == PLACE) & exact, imp), F.when(many & F.col("b_lat").isNull(), town), F.when(many & (F.col("grade") > 0) & F.col("b_lat").isNull(), imp)]
    order = [F.desc(F.coalesce(m.cast("double"), F.lit(0.0))) for m in merge] + [F.desc("rk"), F.desc(unitless), F.col("country"), F.col("doc_id")]
    rows = rows.withColumn("of", F.col("qid.qid"))
    out = se.top(rows, ["of"], order, limit)
    return out.select(F.col("of").alias("qid"), F.col("pos").cast("long").alias("pos"), "doc_id", "name", F.col("rung").cast("int").alias("rung"), F.col("lifted").alias("score"))


