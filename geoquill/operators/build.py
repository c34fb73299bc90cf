"""Builders of the search index: documents of every kind, completion entries, gates of what enters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquill.functions import names as nm
from geoquill.functions import text as tx

from .relational import first_by

#: Kinds of documents.
PLACE, STREET, POI, ADDRESS, POSTCODE = 1, 2, 3, 4, 5
#: Points of interest that completion knows, and lengths of postcodes.
POI_RANK, POSTCODE_LENGTH = 10, (3, 10)
#: Columns of a document; a source that lacks one has null.
DOCUMENT = "doc_id long, country string, kind int, name string, locality string, state string, housenumber string, unit string, postcode string, rank int, importance int, lat double, lng double".split(", ")


def included(df: DataFrame, codes: list[str] | None) -> DataFrame:
    """Rows of the wanted countries; without a list all."""
    return df if not codes else df.where(F.lower("country").isin([c.lower() for c in codes]))


def forward_documents(sources: dict[int, DataFrame]) -> DataFrame:
    """Documents of every kind in one table. ``sources``: kind to rows with any of the document's columns.

    A street of one name in one locality is one document, the least id's; addresses without a number or a street, or with a
    house's name for a number, are left out; a document without importance has 0.
    """
    out = None
    for kind, df in sources.items():
        rows = df.where(F.coalesce(F.trim("name"), F.lit("")) != "")
        if kind == ADDRESS:
            rows = rows.where("trim(housenumber) <> ''")
            rows = rows.where(~F.coalesce(F.col("is_name"), F.lit(False))) if "is_name" in df.columns else rows
        if kind == STREET:
            rows = first_by(rows, ["country", "name", "locality"], [F.col("doc_id")])
        cols = []
        for spec in DOCUMENT:
            name, dtype = spec.split(" ")
            c = F.lit(kind) if name == "kind" else F.col(name) if name in df.columns else F.lit(None)
            c = F.coalesce(c, F.lit(0)) if name == "importance" else c
            cols.append(c.cast(dtype).alias(name))
        rows = rows.select(*cols)
        out = rows if out is None else out.unionByName(rows)
    return out


def with_alternates(docs: DataFrame, aliases: DataFrame) -> DataFrame:
    """``docs`` with alt: aliases (id, alias) of the document, its name without an article, before a preposition, and in
    Latin letters. Tokens that the name itself has are left out."""
    own = aliases.groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("alias").alias("_more"))
    rows = docs.join(own, "doc_id", "left")
    every = F.concat(F.coalesce("_more", F.array().cast("array<string>")), F.array(tx.strip_article(F.col("name")), tx.short_form(F.col("name"))), nm.transliterate(F.col("name")))
    words = F.flatten(F.transform(F.filter(every, lambda x: x.isNotNull()), lambda x: tx.words(F.lower(tx.fold(x)))))
    alt = F.array_sort(F.array_except(F.array_distinct(words), tx.words(F.lower(tx.fold(F.col("name"))))))
    return rows.withColumn("alt", F.array_join(alt, " ")).drop("_more")


def address_keys(docs: DataFrame) -> DataFrame:
    """``docs`` with the keys that addresses are found by: number and unit without their designators, plain postcode."""
    return docs.withColumns({"house_key": F.lower(F.trim("housenumber")), "unit_key": tx.unit_key(F.col("unit")), "postcode_key": tx.postcode(F.col("postcode"))})


def completion_names(docs: DataFrame, aliases: DataFrame, countries: list[str] | None = None) -> DataFrame:
    """(country, id, name, rank) of everything that completion may show: places, streets, well-known points of interest and
    postcodes of a sound length, under their names and aliases."""
    rows = included(docs, countries)
    poi = (F.col("kind") != POI) | (F.col("rank") <= POI_RANK)
    code = (F.col("kind") != POSTCODE) | F.length("name").between(*POSTCODE_LENGTH)
    rows = rows.where((F.col("kind") != ADDRESS) & poi & code).select("country", F.col("doc_id").alias("id"), "name", "rank")
    latin = rows.select("country", "id", F.explode(nm.transliterate(F.col("name"))).alias("name"), "rank")
    other = rows.drop("name").join(aliases.select("id", F.col("alias").alias("name")), "id").select("country", "id", "name", "rank")
    return rows.unionByName(latin).unionByName(other)


def named_in(query: Column, name: Column) -> Column:
    """Whether every token of a text is among a name's: what a spelling correction must have kept."""
    return F.size(F.array_except(tx.words(F.lower(tx.fold(query))), tx.words(F.lower(tx.fold(name))))) == 0
