"""Address text as Column functions: folding, tokens, street types, ordinals, house numbers, postcodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters folded to ASCII, position by position; the sharp s folds to two letters.
ACCENTED = "áàâäãåÁÀÂÄÃÅéèêëÉÈÊËíìîïÍÌÎÏóòôöõøÓÒÔÖÕØúùûüÚÙÛÜñÑçÇ"
PLAIN = "aaaaaaAAAAAAeeeeEEEEiiiiIIIIooooooOOOOOOuuuuUUUUnNcC"
#: Street types and name suffixes by abbreviation.
STREET_TYPES = {
    "hwy": "highway", "pde": "parade", "tce": "terrace", "ter": "terrace", "cres": "crescent", "blvd": "boulevard", "blv": "boulevard",
    "bvd": "boulevard", "ln": "lane", "ave": "avenue", "av": "avenue", "rd": "road", "dr": "drive", "tr": "trail", "ct": "court",
    "cl": "close", "pl": "place", "pkwy": "parkway", "sq": "square", "cir": "circle", "trl": "trail", "xing": "crossing", "aly": "alley",
    "fwy": "freeway", "expy": "expressway", "plz": "plaza", "hts": "heights", "pt": "point", "ctr": "center", "cv": "cove",
    "gdns": "gardens", "grv": "grove", "gve": "grove", "gr": "grove", "jct": "junction", "mnr": "manor", "pk": "park", "rdg": "ridge",
    "rte": "route", "vlg": "village", "vw": "view", "wy": "way", "esp": "esplanade", "cct": "circuit", "crs": "crescent", "qy": "quay",
    "tpke": "turnpike", "wk": "walk", "wlk": "walk", "cswy": "causeway", "brg": "bridge", "byp": "bypass", "lp": "loop", "pwy": "parkway",
    "jr": "junior", "sr": "senior",
}
#: Ordinal words from first to twentieth, and tens that open a compound.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
#: Compass words.
COMPASS = "n s e w ne nw se sw north south east west northeast northwest southeast southwest".split()
#: Unit designators in front of a unit, at search time and in tags.
UNIT_WORDS = "apt apartment unit suite ste flat rm room".split()
UNIT_TAGS = "apt apt. apartment apartments flat unit suite ste ste. room rm rm. app apto appt appartement wohnung whg top lokal interno int int.".split()
#: Prepositions inside compound place names, in the order they are tried.
PREPOSITIONS = [" am ", " an ", " upon ", " on ", " under ", "-under-", " im ", " bei ", " sur ", " of ", " near ", " by "]
#: Leading articles of place names, and elided ones.
ARTICLES = "the le la les el los las il lo i gli o a os as els der die das de het y yr".split()
ELIDED = ["l'", "l’", "d'", "d’", "n'", "n’"]
#: Australian states by what people write.
AU_STATES = {
    "nsw": "New South Wales", "vic": "Victoria", "victoria": "Victoria", "qld": "Queensland", "queensland": "Queensland", "wa": "Western Australia",
    "sa": "South Australia", "tas": "Tasmania", "tasmania": "Tasmania", "nt": "Northern Territory", "act": "Australian Capital Territory",
}
#: Canadian provinces by postal code.
CA_PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador", "NS": "Nova Scotia",
    "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Québec", "PQ": "Québec",
    "SK": "Saskatchewan", "YT": "Yukon",
}
#: States of the USA by postal code.
US_STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware",
    "DC": "District of Columbia", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota",
    "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire", "NJ": "New Jersey", "NM": "New Mexico",
    "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia",
    "WA": "Washington", "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming",
}
#: Boroughs of New York by county.
BOROUGHS = {"New York County": "Manhattan", "Kings County": "Brooklyn", "Queens County": "Queens", "Bronx County": "Bronx", "Richmond County": "Staten Island"}


def mapping(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def fold(c: Column) -> Column:
    """Common accented Latin letters to ASCII."""
    return F.replace(F.translate(c, ACCENTED, PLAIN), F.lit("ß"), F.lit("ss"))


def words(c: Column) -> Column:
    """Runs of letters and digits."""
    return F.filter(F.split(c, r"[^\p{L}\p{N}]+"), lambda w: w != "")


def leading_places(tokens: Column) -> Column:
    """Saint, Mount and Fort to their short forms, but never the last token ("Main St" is a street)."""
    short = F.create_map(*[F.lit(x) for k, v in {"saint": "st", "sainte": "st", "st": "st", "ste": "st", "mount": "mt", "mt": "mt", "fort": "ft", "ft": "ft"}.items() for x in (k, v)])
    # a variable of an outer lambda: an expression inside the inner one would be evaluated for every token
    bound = F.transform(F.array(tokens), lambda w: F.transform(w, lambda t, i: F.when(i < F.size(w) - 1, F.coalesce(F.try_element_at(short, t), t)).otherwise(t)))
    return F.get(bound, F.lit(0))


def key(c: Column) -> Column:
    """The normalised key of a name: folded, lower case, words joined by single spaces, leading Saint, Mount, Fort shortened."""
    return F.array_join(leading_places(words(F.lower(fold(c)))), " ")


def locality(c: Column) -> Column:
    """Locality for postcode lookup: folded, lower case, single spaces."""
    return F.array_join(words(F.lower(fold(c))), " ")


def join_initials(c: Column) -> Column:
    """Dotted initials to one word: "n.y.c." to "nyc", "l.a" to "la"; "st. kilda" stays."""
    spans = r"(?<![\p{L}\p{N}])(?:\p{L}\.){2,}(?:\p{L})?(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\p{L}\.\p{L}(?![\p{L}\p{N}])"
    found = F.regexp_extract_all(c, F.lit(f"({spans})"), F.lit(1))
    return F.aggregate(found, c, lambda acc, x: F.replace(acc, x, F.replace(x, F.lit("."), F.lit(""))))


def ordinal(n: Column) -> Column:
    tens, ones = n % 100, n % 10
    tail = F.when(tens.between(11, 13), "th").when(ones == 1, "st").when(ones == 2, "nd").when(ones == 3, "rd").otherwise("th")
    return F.concat(n.cast("string"), tail)


def street_types(tokens: Column) -> Column:
    """Abbreviated street types in full; "st" is street where only compass words follow and something stands before."""
    full = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(mapping(STREET_TYPES), t), t))
    compass = F.array(*map(F.lit, COMPASS))
    at = F.array_max(F.filter(F.sequence(F.lit(0), F.size(full) - 1), lambda i: ~F.array_contains(compass, F.get(full, i))))
    out = F.transform(full, lambda t, i: F.when((t == "st") & (i == at) & (at > 0), "street").otherwise(t))
    return F.when(F.size(tokens) > 0, out).otherwise(tokens)


def compound_ordinals(tokens: Column) -> Column:
    """Tens before a word of one to nine become one ordinal: "twenty first" to "21st"."""
    tens, ones = mapping(TENS), F.array(*map(F.lit, ORDINALS[:9]))
    nxt = lambda i: F.array_position(ones, F.coalesce(F.get(tokens, i + 1), F.lit("")))
    opens = lambda i: F.try_element_at(tens, F.get(tokens, i)).isNotNull() & (nxt(i) > 0)
    made = F.transform(tokens, lambda t, i: F.when(opens(i), ordinal(F.try_element_at(tens, t) + nxt(i).cast("int"))).when((i > 0) & opens(F.greatest(i - 1, F.lit(0))), F.lit(None).cast("string")).otherwise(t))
    return F.filter(made, lambda t: t.isNotNull())


def ordinals(tokens: Column, house_first: bool = True) -> Column:
    """"fifth", "5th" and "5" before a street type to "5th"; a number in first place is a house number if so told."""
    names = F.array(*map(F.lit, ORDINALS))
    kinds = F.array(*map(F.lit, sorted({"street", "way", *(v for v in STREET_TYPES.values() if v not in ("junior", "senior"))})))

    def one(t: Column, i: Column) -> Column:
        digits = F.nullif(F.regexp_extract(t, r"^([0-9]+)(?:st|nd|rd|th)$", 1), F.lit("")).try_cast("int")
        bare = F.nullif(F.regexp_extract(t, r"^([0-9]+)$", 1), F.lit("")).try_cast("int")
        before_type = F.coalesce(F.array_contains(kinds, F.get(tokens, i + 1)), F.lit(False))
        word = F.nullif(F.array_position(names, t).cast("int"), F.lit(0))
        n = F.coalesce(word, digits, F.when(before_type & ((i > 0) | F.lit(not house_first)), bare))
        return F.coalesce(ordinal(n), t)

    return F.transform(tokens, one)


def user_tokens(df, id_: str, text: str):
    """(id, tokens) of queries: comma parts are canonicalised on their own, then joined, and place words folded."""
    parts = df.select(id_, F.posexplode(F.split(join_initials(F.lower(fold(F.col(text)))), ",")).alias("k", "p"))
    parts = parts.select(id_, "k", words(F.col("p")).alias("w"))
    doctor = F.when((F.size("w") > 2) & (F.get("w", F.lit(0)) == "dr"), F.concat(F.array(F.lit("doctor")), F.slice("w", F.lit(2), F.size("w") - 1))).otherwise(F.col("w"))
    for step in (lambda c: doctor, street_types, compound_ordinals, ordinals):
        parts = parts.select(id_, "k", step(F.col("w")).alias("w"))
    whole = parts.groupBy(id_).agg(F.sort_array(F.collect_list(F.struct("k", "w"))).alias("w"))
    return whole.select(id_, F.flatten("w.w").alias("w")).select(id_, leading_places(F.col("w")).alias("tokens"))


def unit_key(c: Column) -> Column:
    """A unit without its designator, lower case."""
    low = F.lower(F.trim(F.regexp_replace(F.trim(c), r"^#+", "")))
    return F.regexp_replace(low, r"^(?:" + "|".join(UNIT_WORDS) + r")\s+", "")


def postcode(c: Column) -> Column:
    return F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))


def display_postcode(c: Column, country: Column) -> Column:
    """The British and Canadian spellings have a space before the last three characters."""
    p = postcode(c)
    split = ((country == "GB") & (F.length(p) >= 5)) | ((country == "CA") & (F.length(p) == 6))
    return F.when(split, F.concat_ws(" ", F.substr(p, F.lit(1), F.length(p) - 3), F.right(p, F.lit(3)))).otherwise(p)


def au_unit(c: Column) -> Column:
    """(unit, number) of "3/827a"; nulls otherwise."""
    shape = r"^\s*([0-9]+)\s*/\s*([0-9][^/]*?)\s*$"
    got = lambda k: F.nullif(F.regexp_extract(c, shape, k), F.lit(""))
    return F.struct(got(1).alias("unit"), got(2).alias("number"))


def bind(value: Column, f) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def parse_house(c: Column) -> Column:
    """(first, last, suffix) of a house number or range; nulls without a leading digit or beyond 32 bits."""
    shape = r"^\s*([0-9]+)\s*([^-]*?)\s*(?:-\s*([0-9]+)[^-]*(?:-.*)?)?$"
    part = lambda k: F.nullif(F.regexp_extract(c, shape, k), F.lit(""))
    found = F.struct(part(1).try_cast("long").alias("a"), F.coalesce(part(3), part(1)).try_cast("long").alias("b"), F.regexp_extract(c, shape, 2).alias("s"))

    def ordered(x: Column) -> Column:
        ok = (x["a"] <= 4294967295) & (x["b"] <= 4294967295)
        return F.struct(F.when(ok, F.least(x["a"], x["b"])).alias("first"), F.when(ok, F.greatest(x["a"], x["b"])).alias("last"), F.when(ok, x["s"]).alias("suffix"))

    return bind(found, ordered)


def house_matches(query: Column, stored: Column) -> Column:
    """Equal text, or overlapping ranges; a suffix asked for must be there, or stand inside a true range."""

    def overlap(x: Column) -> Column:
        q, s = x["q"], x["s"]
        suffix = (q["suffix"] == "") | F.when(s["suffix"] != "", F.lower(q["suffix"]) == F.lower(s["suffix"])).otherwise(s["first"] != s["last"])
        return F.coalesce(suffix & (q["first"] <= s["last"]) & (s["first"] <= q["last"]), F.lit(False))

    return (F.lower(query) == F.lower(stored)) | bind(F.struct(parse_house(query).alias("q"), parse_house(stored).alias("s")), overlap)


def split_house(c: Column) -> Column:
    """(unit, number) of a free-form tag: designator forms first, then "3/827a", else the whole is the number."""
    t = F.trim(c)
    tags = "|".join(w.replace(".", r"\.") for w in sorted(UNIT_TAGS, key=len, reverse=True))
    shape = r"(?i)^((?:" + tags + r")(?![A-Za-z])[^/,;]*?)\s*[/,;]\s*([0-9].*)$"
    short = r"^([0-9]+[A-Za-z]?)\s*/\s*([0-9].*)$"
    got = lambda p, k: F.nullif(F.regexp_extract(t, p, k), F.lit(""))
    unit = F.coalesce(got(shape, 1), got(short, 1))
    return F.struct(unit.alias("unit"), F.when(unit.isNotNull(), F.coalesce(got(shape, 2), got(short, 2))).otherwise(F.nullif(t, F.lit(""))).alias("number"))


def strip_article(c: Column) -> Column:
    """The name behind a leading article, or null."""
    t = F.ltrim(c)
    elided = F.regexp_extract(t, r"(?i)^(?:" + "|".join(ELIDED) + r")\s*(.+)$", 1)
    plain = F.regexp_extract(t, r"(?i)^(?:" + "|".join(ARTICLES) + r")\s+(.+)$", 1)
    return F.coalesce(F.nullif(elided, F.lit("")), F.nullif(plain, F.lit("")))


def short_form(c: Column) -> Column:
    """What stands before the first preposition of the list that the name holds, or null."""
    low = F.lower(c)
    cuts = [F.when(F.instr(low, p) > 0, F.trim(F.substr(c, F.lit(1), F.instr(low, p) - 1))) for p in PREPOSITIONS]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in cuts])


def title_case(c: Column) -> Column:
    """Upper-case source names with each run of letters capitalised."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.left(r, F.lit(1))), F.lower(F.substr(r, F.lit(2))))), "")


def country_label(c: Column) -> Column:
    """Two ASCII letters in lower case, else "unknown"."""
    t = F.trim(F.coalesce(c, F.lit("")))
    return F.when(t.rlike("^[A-Za-z]{2}$"), F.lower(t)).otherwise("unknown")


def explains(words_: Column, given: Column) -> Column:
    """Whether the given tokens are the first tokens of the others."""
    return F.slice(words_, F.lit(1), F.size(given)) == given


def whole_phrase(text: Column, phrase: Column) -> Column:
    """Whether a phrase stands in a text between non-alphanumeric neighbours."""
    pad = lambda x: F.concat(F.lit(" "), F.regexp_replace(x, r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return (F.length(phrase) > 0) & F.contains(pad(text), pad(phrase))


def name_matches(a: Column, b: Column) -> Column:
    """Administrative names: equal, one inside the other, or one the initials of the other."""
    x, y = F.lower(fold(a)), F.lower(fold(b))
    initials = lambda t: F.array_join(F.transform(words(t), lambda w: F.left(w, F.lit(1))), "")
    return (x == y) | F.contains(x, y) | F.contains(y, x) | (initials(x) == y) | (initials(y) == x)


def stratum(number: Column, unit: Column) -> Column:
    """plain, unit, suffix or range: the sampling stratum of an address."""
    return F.when(F.coalesce(unit, F.lit("")) != "", "unit").when(number.rlike("-"), "range").when(number.rlike("[A-Za-z]"), "suffix").otherwise("plain")


def percent_encode(c: Column) -> Column:
    return F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))


def csv_field(c: Column) -> Column:
    """Quoted where commas, quotes or line ends make it needful."""
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def remove_ordinals(c: Column) -> Column:
    return F.regexp_replace(c, "([0-9]+)(?i:st|nd|th|rd)", "$1")


def osa_distance(a: Column, b: Column, most: int) -> Column:
    """True where one word becomes the other by at most ``most`` (1 or 2) edits; a swap of neighbours is one edit.

    Levenshtein distance counts a swap as two, so each single swap is tried, with the edits that remain behind it; of two
    edits both may be swaps.
    """
    plain = F.levenshtein(a, b) <= most

    def swapped(x: Column, i: Column) -> Column:
        return F.concat(F.substr(x, F.lit(1), i - 1), F.substr(x, i + 1, F.lit(1)), F.substr(x, i, F.lit(1)), F.substr(x, i + 2))

    spots = F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1)))
    swap = F.exists(spots, lambda i: F.levenshtein(swapped(a, i), b) <= most - 1)
    if most > 1:
        swap = swap | F.exists(spots, lambda i: F.exists(spots, lambda j: swapped(swapped(a, i), j) == b))
    return plain | ((F.length(a) >= 2) & (F.abs(F.length(a) - F.length(b)) <= most - 1) & swap)
