"""Free-form address queries taken apart: house number, unit, postcode, state, the rest. Columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as tx

#: New Zealand regions that may end a query.
NZ_REGIONS = {x: x.title() for x in ("wellington", "auckland", "canterbury", "otago", "waikato", "northland")}
#: Shapes of postcodes at the end of a query, by country, over the last one or two tokens.
POSTCODES = {"GB": r"^[a-z]{1,2}[0-9][a-z0-9]?[0-9][a-z]{2}$", "CA": r"^[a-z][0-9][a-z][0-9][a-z][0-9]$", "US": r"^[0-9]{5}$", "AU": r"^[0-9]{4}$", "NZ": r"^[0-9]{4}$"}
ORDINAL = r"^[0-9]+(?:st|nd|rd|th)$"


def _get(c: Column, i) -> Column:
    return F.get(c, F.lit(i) if isinstance(i, int) else i)


def freeform(df: DataFrame, id_: str, text: str, country: str) -> DataFrame:
    """(id, house, unit, postcode, state, rest) of each query; what is not there is null.

    A leading "3/827a" gives unit and house; a leading range is the house; "#4" and "Unit 4" give the unit; the last
    token or two, shaped as the country's postcode, give that; then the first token with a leading digit that is no
    ordinal, or a last bare number of up to three or of five digits, is the house. Later tokens may be a state.
    """
    raw = F.trim(F.col(text))
    au = r"^\s*([0-9]+)\s*/\s*([0-9][A-Za-z0-9]*(?:-[0-9]+)?)(?=[\s,]|$)"
    span = r"^([0-9]+(?:-[0-9]+)+),?\s"
    some = lambda c, p, k: F.nullif(F.regexp_extract(c, p, k), F.lit(""))
    rows = df.select(id_, F.upper(F.coalesce(F.col(country), F.lit("AU"))).alias("cc"), raw.alias("t"))
    rows = rows.select(id_, "cc", some(F.col("t"), au, 1).alias("unit"), F.lower(F.coalesce(some(F.col("t"), au, 2), some(F.col("t"), span, 1))).alias("house"), F.regexp_replace(F.regexp_replace("t", au, ""), span, "").alias("t"))
    hash_ = r"#\s*([\p{L}\p{N}]+)"
    take = F.col("unit").isNull()
    rows = rows.select(id_, "cc", "house", F.coalesce("unit", F.lower(some(F.col("t"), hash_, 1))).alias("unit"), F.when(take, F.regexp_replace("t", hash_, "")).otherwise(F.col("t")).alias("t"))
    rows = rows.join(tx.user_tokens(rows.select(id_, "t"), id_, "t"), id_)
    w = F.col("tokens")
    words = F.array(*map(F.lit, tx.UNIT_WORDS))
    at = F.when((F.size(w) > 0) & F.col("unit").isNull(), F.try_element_at(F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.array_contains(words, F.coalesce(_get(w, i), F.lit(""))) & F.coalesce(_get(w, i + 1).rlike("^[0-9]|^.$"), F.lit(False))), F.lit(1)))
    rows = rows.withColumn("at", at)
    rows = rows.select(id_, "cc", "house", F.coalesce("unit", _get(w, F.col("at") + 1)).alias("unit"), F.when(F.col("at").isNull(), w).otherwise(F.filter(w, lambda x, i: (i != F.col("at")) & (i != F.col("at") + 1))).alias("w"))
    w, n = F.col("w"), F.size("w")
    shape = F.coalesce(F.try_element_at(tx.mapping(POSTCODES), F.col("cc")), F.lit("^[0-9]{4,6}$"))
    last, pair = _get(w, n - 1), F.concat(_get(w, n - 2), _get(w, n - 1))
    tail = F.when((n > 2) & F.coalesce(F.regexp(pair, shape), F.lit(False)), 2).when((n > 1) & F.coalesce(F.regexp(last, shape), F.lit(False)), 1).otherwise(0)
    rows = rows.withColumn("tail", tail)
    rows = rows.select(id_, "cc", "house", "unit", F.when(F.col("tail") == 2, F.upper(pair)).when(F.col("tail") == 1, F.upper(last)).alias("postcode"), F.slice(w, F.lit(1), F.greatest(n - F.col("tail"), F.lit(0))).alias("w"))
    w, n = F.col("w"), F.size("w")
    first = (n > 0) & _get(w, 0).rlike("^[0-9]") & ~_get(w, 0).rlike(ORDINAL)
    end = (n > 1) & _get(w, n - 1).rlike("^(?:[0-9]{1,3}|[0-9]{5})$")
    open_ = F.col("house").isNull()
    rows = rows.withColumn("f", open_ & F.coalesce(first, F.lit(False))).withColumn("e", open_ & ~F.coalesce(first, F.lit(False)) & F.coalesce(end, F.lit(False)))
    rows = rows.select(id_, "cc", F.when(F.col("f"), _get(w, 0)).when(F.col("e"), _get(w, n - 1)).otherwise(F.col("house")).alias("house"), "unit", "postcode",
                       F.when(F.col("f"), F.slice(w, F.lit(2), F.greatest(n - 1, F.lit(0)))).when(F.col("e"), F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(w).alias("w"))
    w, n = F.col("w"), F.size("w")
    tail_state = F.upper(_get(w, n - 1))
    state = F.when(F.col("cc") == "US", F.try_element_at(tx.mapping(tx.US_STATES), tail_state)).when(F.col("cc") == "CA", F.try_element_at(tx.mapping(tx.CA_PROVINCES), tail_state))
    state = state.when(F.col("cc") == "NZ", F.try_element_at(tx.mapping(NZ_REGIONS), F.lower(tail_state)))
    au_at = F.try_element_at(F.filter(F.sequence(F.lit(0), n), lambda i: F.try_element_at(tx.mapping(tx.AU_STATES), _get(w, i)).isNotNull()), F.lit(1))
    rows = rows.withColumn("sa", F.when((F.col("cc") == "AU") & (n > 1), au_at)).withColumn("st", F.when(n > 1, state))
    gone = F.when(F.col("cc") == "AU", F.col("sa")).when(F.col("st").isNotNull(), n - 1)
    rows = rows.withColumn("gone", F.coalesce(gone, F.lit(-1))).withColumn("state", F.coalesce("st", F.try_element_at(tx.mapping(tx.AU_STATES), _get(w, F.col("sa")))))
    return rows.select(id_, "house", "unit", "postcode", "state", F.array_join(F.filter(w, lambda x, i: i != F.col("gone")), " ").alias("rest"))
