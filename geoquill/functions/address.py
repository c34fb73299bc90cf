"""Addresses of map tags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as tx


def from_tags(tags: Column, associated: Column) -> Column:
    """(number, street, unit, floor, parent, postcode, by_place, is_name) of a tag map, null where it makes no address.

    Number: the tag, or conscription and street number with a slash between, else the full address or the house's name.
    Street: the tag, the place, or the street of a relation that holds the object.
    """
    got = lambda k: F.nullif(F.try_element_at(tags, F.lit(k)), F.lit(""))
    first = lambda *ks: F.coalesce(*[F.try_element_at(tags, F.lit(k)) for k in ks])
    written, street_no = got("addr:conscriptionnumber"), got("addr:streetnumber")
    composed = F.nullif(F.concat_ws("/", written, street_no), F.lit(""))
    parts = tx.split_house(F.coalesce(got("addr:housenumber"), composed))
    name = F.coalesce(got("addr:full"), got("addr:housename"))
    number = F.coalesce(parts["number"], name)
    street = F.coalesce(got("addr:street"), got("addr:place"), F.nullif(associated, F.lit("")))
    unit = F.coalesce(F.nullif(first("addr:unit", "addr:flat", "addr:door"), F.lit("")), parts["unit"])
    made = F.struct(
        number.alias("number"), street.alias("street"), unit.alias("unit"), first("addr:floor", "addr:level").alias("floor"),
        first("addr:city", "addr:suburb", "addr:locality", "addr:state").alias("parent"), F.try_element_at(tags, F.lit("addr:postcode")).alias("postcode"),
        (got("addr:street").isNull() & got("addr:place").isNotNull()).alias("by_place"), parts["number"].isNull().alias("is_name"),
    )
    return F.when(number.isNotNull() & street.isNotNull(), made)
