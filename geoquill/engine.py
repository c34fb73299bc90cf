"""The engine: requests in, answers out, each a DataFrame keyed by qid."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from geoquill.functions import geo, parse
from geoquill.functions import names as nm
from geoquill.functions import text as tx
from geoquill.operators import build, ladder
from geoquill.operators import relational as rel
from geoquill.operators import search as se
from geoquill.operators import spatial as sp

#: How far an address, an interpolated number or a street may lie, and a point of interest, in metres.
ADDRESS_M, POI_M = 75.0, 30.0
#: Results of a request unless it says otherwise, and at most.
LIMIT, MOST = 10, 50
#: Indexed fields of a document.
FIELDS = ["name", "alt", "locality", "state"]


@dataclass
class Engine:
    """Tables by name; an operator whose table is missing answers with nulls.

    polygons: id, name, level, ring, area, country_code. places: id, name, lat, lng, rank, importance. pois: id, name, lat,
    lng, rank, category. addresses: id, lat, lng, housenumber, street, unit, postcode, city, source. ways: id, name,
    nodes, start_no, end_no, kind. documents: doc_id, country, kind, name, locality, state, housenumber, unit, postcode,
    rank, importance, lat, lng. mapping: as for :func:`admin_fields`. names: id, lang, alias. ranges: lo, hi, lat, lng.
    """

    tables: dict[str, DataFrame]
    address_deg: float = 0.01
    place_deg: float = 0.5
    polygon_deg: float = 1.0
    folder: str | None = None
    _index: DataFrame | None = field(default=None, repr=False)

    def _has(self, name: str) -> bool:
        return name in self.tables

    def reverse(self, queries: DataFrame) -> DataFrame:
        """qid, lat, lng to house_number, road, city, county, state, postcode, country, country_code, poi, confidence, formatted.

        The address within 75 m wins, from the first source that has one; else a number interpolated on a way that near, else
        the street. A city that no polygon gives comes from the nearest place of the best rank.
        """
        q = queries.select("qid", "lat", "lng")
        out = q
        if self._has("polygons"):
            levels = sp.smallest_by_level(sp.point_in_polygon(q, self.tables["polygons"], self.polygon_deg))
            code = levels.groupBy("qid").agg(F.min_by("country_code", "level").alias("country_code"))
            named = levels.drop("country_code").join(code, "qid")
            out = out.join(sp.admin_fields(named, self.tables["mapping"]), "qid", "left").join(code, "qid", "left")
        else:
            for c in ("country", "state", "county", "city", "postcode", "country_code"):
                out = out.withColumn(c, F.lit(None).cast("string"))
        if self._has("places"):
            near = sp.nearest_ranked(q, self.tables["places"].select("id", "name", "lat", "lng", "rank"), self.place_deg)
            out = out.join(near.select("qid", F.col("name").alias("near_city")), "qid", "left").withColumn("city", F.coalesce("city", "near_city")).drop("near_city")
        if self._has("addresses"):
            a = self.tables["addresses"].select("id", "lat", "lng", "housenumber", "street", "postcode", "city", "source")
            rows = sp.nearest_on_ladder(q, a, self.address_deg, F.col("source"), None, [F.col("source"), F.col("d"), F.col("id")], within_m=ADDRESS_M)
            out = out.join(rows.select("qid", F.col("housenumber").alias("a_house"), F.col("street").alias("a_road"), F.col("postcode").alias("a_post"), F.col("city").alias("a_city")), "qid", "left")
        else:
            out = out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("a_house", "a_road", "a_post", "a_city")])
        if self._has("ways"):
            w = sp.nearest_way(q, self.tables["ways"], self.address_deg).where(F.col("d") < geo.cutoff(ADDRESS_M))
            number = F.when(F.col("start_no").isNotNull(), geo.interpolated_number(F.col("start_no"), F.col("end_no"), F.col("t"), F.col("kind")).cast("string"))
            out = out.join(w.select("qid", F.col("name").alias("w_road"), number.alias("w_house")), "qid", "left")
        else:
            out = out.select("*", *[F.lit(None).cast("string").alias(c) for c in ("w_road", "w_house")])
        if self._has("pois"):
            p = sp.nearest_ranked(q, self.tables["pois"].select("id", "name", "lat", "lng", "rank"), self.address_deg, POI_M)
            out = out.join(p.select("qid", F.col("name").alias("poi")), "qid", "left")
        else:
            out = out.withColumn("poi", F.lit(None).cast("string"))
        exact = F.col("a_road").isNotNull()
        out = out.select(
            "qid",
            F.when(exact, F.col("a_house")).otherwise(F.col("w_house")).alias("house_number"),
            F.coalesce("a_road", "w_road").alias("road"),
            F.coalesce("city", "a_city").alias("city"),
            "county", "state",
            F.coalesce("a_post", "postcode").alias("postcode"),
            "country", "country_code", "poi",
            F.when(exact, "exact").when(F.col("w_house").isNotNull(), "interpolated").otherwise("fallback").alias("confidence"),
        )
        c = F.col
        return out.withColumn("formatted", sp.format_address(c("house_number"), c("road"), c("city"), c("state"), c("postcode"), c("country"), c("country_code")))

    def _fields(self) -> DataFrame:
        return self.tables["documents"].withColumn("alt", tx.strip_article(F.col("name")))

    def index(self) -> DataFrame:
        """Postings of the documents; with a ``folder`` they are written there once, by term, and read from then on."""
        if self._index is None:
            made = se.postings(self._fields(), FIELDS, ["country"])
            if self.folder:
                made.repartitionByRange("term").sortWithinPartitions("term", "country").write.mode("overwrite").parquet(f"{self.folder}/postings")
                made = self.tables["documents"].sparkSession.read.schema(made.schema).parquet(f"{self.folder}/postings")
            self._index = made
        return self._index

    def _retrieve(self, q: DataFrame) -> DataFrame:
        """Documents of the query's country that hold every word of its rest, with the first rung that lets them pass.

        The rungs ask for ever less, so one retrieval serves them all: 0 everything asked for, 1 without the unit, 2 without
        the postcode, 3 the text alone. A query keeps the hits of its lowest rung.
        """
        terms = q.select("qid", "cc", F.explode(F.array_distinct(F.split("rest", " "))).alias("term")).where("term <> ''")
        lengths = se.field_lengths(self._fields(), FIELDS, ["country"])
        hits = se.all_terms(se.bm25(self.index(), lengths, terms.select("qid", "term"), ["country"]), terms)
        rows = hits.join(self.tables["documents"].drop("country"), "doc_id").join(q.drop("rest"), "qid")
        rows = rows.where(F.col("cc").isNull() | (F.col("cc") == F.col("country")))
        text = lambda c: F.coalesce(F.col(c), F.lit(""))
        asked = F.col("q_house").isNotNull()
        house = F.when(asked, (F.col("kind") == 4) & tx.house_matches(text("q_house"), text("housenumber"))).otherwise(F.col("kind") != 4)
        unit = F.col("q_unit").isNull() | (tx.unit_key(text("unit")) == F.col("q_unit"))
        code = F.col("q_postcode").isNull() | (tx.postcode(text("postcode")) == F.col("q_postcode"))
        rows = rows.select("*", house.alias("h"), unit.alias("u"), code.alias("p"))
        rows = rows.withColumn("rung", F.when(F.col("h") & F.col("u") & F.col("p"), 0).when(F.col("h") & F.col("p"), 1).when(F.col("h"), 2).otherwise(3))
        lowest = F.min("rung").over(Window.partitionBy("qid"))
        score = se.prominence(F.col("score"), F.col("rank"), F.col("importance"), F.col("kind") == 3)
        return rows.withColumn("lowest", lowest).where("rung = lowest").withColumn("score", F.round(score, 4))

    def search(self, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
        """qid, q, country to ranked hits: doc_id, name, score, rung, pos."""
        hits = self._retrieve(self._parsed(queries))
        order = [F.desc("score"), F.desc("importance"), F.col("rank"), F.col("doc_id")]
        return se.top(hits, ["qid"], order, max(1, min(MOST, limit))).select("qid", "doc_id", "name", "score", "rung", "pos", "lat", "lng")

    def ranked_search(self, queries: DataFrame, aliases: DataFrame | None = None, limit: int = LIMIT) -> DataFrame:
        """All rungs, bias points, countries behind the text and known aliases: see :mod:`.operators.ladder`."""
        docs = self.tables["documents"]
        docs = docs if "alt" in docs.columns else build.with_alternates(docs, docs.sparkSession.createDataFrame([], "id long, alias string"))
        index, lengths = se.postings(docs, ladder.FIELDS, ["country"]), se.field_lengths(docs, ladder.FIELDS, ["country"])
        return ladder.search(queries, docs, index, lengths, aliases, max(1, min(MOST, limit)))

    def enrich(self, hits: DataFrame) -> DataFrame:
        """Hits (qid, pos, name, lat, lng) with the area around them and a label: name, city, state, postcode, country, none twice."""
        at = self.reverse(hits.select(F.struct("qid", "pos").alias("qid"), "lat", "lng")).select("qid.qid", "qid.pos", "city", "state", "postcode", "country")
        return hits.join(at, ["qid", "pos"], "left").withColumn("label", nm.label(F.col("name"), F.col("city"), F.col("state"), F.col("postcode"), F.col("country")))

    def _parsed(self, queries: DataFrame) -> DataFrame:
        parts = parse.freeform(queries, "qid", "q", "country").join(queries.select("qid", F.upper("country").alias("cc")), "qid")
        return parts.select("qid", "cc", F.col("house").alias("q_house"), F.col("unit").alias("q_unit"), F.col("postcode").alias("q_postcode"), "rest")

    def repair(self, queries: DataFrame, most: int = 16) -> DataFrame:
        """(qid, doc_id, name, rest) for queries with white space put wrong once: one pair joined or one word split.

        Candidates whose words the index does not have are dropped; a query with more than ``most`` left, or whose candidates
        find more than one address, gets no answer. Meant for queries that :meth:`search` left without one.
        """
        q = self._parsed(queries)
        c = q.select("qid", F.explode(se.split_join_candidates(F.split("rest", " "))).alias("rest"))
        words = c.select("qid", "rest", F.explode(F.split("rest", " ")).alias("term"))
        known = words.join(self.index().select("term").distinct(), "term", "left_anti").select("qid", "rest").distinct()
        c = c.join(known, ["qid", "rest"], "left_anti")
        few = c.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") <= most).select("qid")
        c = c.join(few, "qid").join(q.drop("rest"), "qid")
        ask = c.select(F.struct("qid", "rest").alias("qid"), "cc", "q_house", "q_unit", "q_postcode", "rest")
        hits = self._retrieve(ask).where("rung < 3").select("qid.qid", "qid.rest", "doc_id", "name")
        alone = hits.groupBy("qid").agg(F.count_distinct("doc_id").alias("n")).where("n = 1").select("qid")
        return hits.join(alone, "qid").dropDuplicates(["qid"]).select("qid", "doc_id", "name", "rest")

    def respell(self, queries: DataFrame, ratio: int = 50) -> DataFrame:
        """(qid, q, country) with each rare word of the rest replaced by a much commoner one within its edits."""
        q = self._parsed(queries)
        words = q.select("qid", F.posexplode(F.split("rest", " ")).alias("pos", "term")).where("term <> ''")
        fixed = words.join(se.correct_spelling(self.index(), words, ratio), "term", "left")
        changed = fixed.groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("pos", F.coalesce("fixed", "term").alias("t")))).alias("w"), F.max(F.col("fixed").isNotNull()).alias("any")).where("any")
        out = changed.join(q, "qid").join(queries.select("qid", "country"), "qid")
        return out.select("qid", F.concat_ws(" ", "q_house", F.array_join("w.t", " "), "q_postcode").alias("q"), "country")

    def nearby(self, queries: DataFrame, radius_m: float, limit: int = LIMIT) -> DataFrame:
        """Every place within the radius, nearest first: exact, not bounded by a search window."""
        return sp.within_radius(queries.select("qid", "lat", "lng"), self.tables["places"].select("id", "name", "lat", "lng"), self.place_deg, radius_m, max(1, min(MOST, limit))).select("qid", "id", "name", F.round("metres", 3).alias("metres"), F.col("rn").alias("pos"))

    def autocomplete(self, queries: DataFrame, limit: int = LIMIT) -> DataFrame:
        """qid, country, prefix to the best entries whose key begins with it."""
        names = self.tables["documents"].where("kind <> 4").select("country", F.col("doc_id").alias("id"), "name", "rank")
        q = queries.select("qid", F.upper("country").alias("country"), tx.key(F.col("prefix")).alias("prefix")).where("prefix <> ''")
        return se.prefix_search(se.autocomplete_entries(names), q, max(1, min(MOST, limit))).select("qid", "id", "name", F.col("pos").cast("long").alias("pos"))

    def validate(self, queries: DataFrame) -> DataFrame:
        """verified, corrected, partial or unverified, from the first hit and the rung that found it."""
        first = self.search(queries, 1).select("qid", "doc_id", "rung")
        return queries.select("qid").join(first, "qid", "left").select("qid", "doc_id", F.when(F.col("rung") == 0, "verified").when(F.col("rung").isin(1, 2), "corrected").when(F.col("rung") == 3, "partial").otherwise("unverified").alias("verdict"))

    def ip(self, queries: DataFrame) -> DataFrame:
        """qid, ip (a number) to the reverse answer of its range."""
        at = rel.range_join(queries.select("qid", "ip"), self.tables["ranges"], "ip", "lo", "hi", 1 << 16).select("qid", "lat", "lng")
        return self.reverse(at)
