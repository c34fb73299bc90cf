"""Name functions over literal cases: the oracle's results are written down, not computed."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoquill.functions import names as nm
from geoquill.functions import parse
from geoquill.functions import text as tx

Q: dict = {}
SQL: dict = {}


def _sql(v) -> str:
    return "null" if v is None else "'" + str(v).replace("'", "''") + "'"


def literal(name: str, cases: list[tuple], fn, table: str = "part", key: str = "p_partkey", extra: int = 0) -> None:
    """A query of ``fn`` (columns to a string column) over all rows of a table, each row taking a case by its key."""
    width = len(cases[0]) - 1

    def run(spark, sf):
        rows = spark.read.parquet(f"{sf}/{table}.parquet").select(F.col(key).alias("id"), (F.col(key) % len(cases)).cast("int").alias("k"))
        args = [F.get(F.array(*[F.lit(c[j]).cast("string") for c in cases]), F.col("k")) for j in range(width)]
        return rows.select("id", *[a.alias(f"a{j}") for j, a in enumerate(args)]).select("id", fn(*[F.col(f"a{j}") for j in range(width)]).cast("string").alias("y"))

    Q[name] = run
    SQL[name] = f"select {key} as id, list_extract([{', '.join(_sql(c[-1]) for c in cases)}], cast({key} % {len(cases)} + 1 as bigint)) as y from {table}"


literal("x17_caps_streets", [
    ("W 168TH ST", "West 168th Street"), ("168 PL", "168th Place"), ("N ST NE", "N Street NE"), ("ST JAMES PL", "St James Place"), ("MCDONALD AVE", "McDonald Avenue"), ("O'NEIL RD", "O'Neil Road"),
    ("Main St", "Main St"), ("AVE OF THE AMERICAS", "Ave Of The Americas"), ("E 21ST ST", "East 21st Street"), ("SMITH-JONES BLVD.", "Smith-Jones Boulevard"), ("US HWY", "US Highway"), ("42", "42"), ("N ST", "N Street"), ("113 TH", "113 Th"),
], nm.caps_street)
literal("x17_caps_names", [("NEW YORK", "New York"), ("ST. LOUIS", "St. Louis"), ("MCALLEN", "McAllen"), ("O'FALLON", "O'Fallon"), ("WINSTON-SALEM", "Winston-Salem"), ("Reno", "Reno"), ("APT 3B", "Apt 3B"), ("WORLD WAR II", "World War II")], nm.caps_name)
literal("x22_script", [
    ("Москва", "cyrillic"), ("Αθήνα", "greek"), ("北京", "han"), ("ひらがな", "hiragana"), ("カタカナ", "katakana"), ("서울", "hangul"), ("الخرطوم", "arabic"), ("ירושלים", "hebrew"), ("กรุงเทพ", "thai"), ("मुंबई", "devanagari"),
    ("Sydney", "latin"), ("Köln", "latin"), ("São Paulo", "latin"),
], nm.script_of)
literal("x22_transliteration", [
    ("Москва", "Moskva"), ("Челябинск", "Chelyabinsk"), ("Екатеринбург", "Ekaterinburg"), ("Θεσσαλονίκη", "Thessaloniki"), ("서울", "seo ul|seoul"), ("부산", "bu san|busan"), ("おおさか", "oosaka"), ("ナゴヤ", "nagoya"), ("さっぽろ", "sapporo"), ("きょうと", "kyouto"), ("しょうなん", "shounan"), ("Sydney", ""), ("北京", ""), ("ふじ", "fuji"),
], lambda c: F.array_join(nm.transliterate(c), "|"))
literal("x23_language_codes", [("en", 28261), ("EN", 28261), ("zh-Hant", 26746), ("nan", 0), ("", 0), ("e1", 0), ("pt-BR", 29808), ("x", 0)], nm.pack_language)
literal("x24_alias_tags", [
    ("name=Roma;;name:en=Rome;;alt_name=Caput Mundi; Urbs ", "alt_name/0/Caput Mundi|alt_name/0/Urbs|name/28261/Rome"), ("name:left=A;;name:nan=B", "alt_name/0/A"), ("old_name:de=Alt;;ref=7", "old_name/25956/Alt|ref/0/7"),
    ("name_typed=x;;reg_name=R", "reg_name/0/R"), ("highway=primary", ""),
], lambda c: F.array_join(F.transform(nm.alias_rows(F.map_from_entries(F.transform(F.split(c, ";;"), lambda e: F.struct(F.substring_index(e, "=", 1).alias("k"), F.substr(e, F.instr(e, "=") + 1).alias("v"))))), lambda a: F.concat_ws("/", a["family"], a["lang"].cast("string"), a["alias"])), "|"))
literal("x25_tidy_aliases", [("N.Y.C.", "NYC"), ("S. Fran", "S Fran"), ("St. Kilda", "St Kilda"), ("  L.A. ", "LA"), ("..", ""), ("Philly", "Philly"), ("N. Y. Town", "NY Town")], nm.tidy_alias)
literal("x25_alias_rules", [
    ("NY", "New York", "initialism"), ("NYC", "New York", "initialism"), ("NewYork", "New York", "compact"), ("San Fran", "San Francisco", "abbreviated"), ("Philly", "Philadelphia", "shortened"), ("Brissie", "Brisbane", "shortened"),
    ("The Hague", "Den Haag", "leading_the"), ("NO", "New Orleans", "common_word"), ("LAX", "Los Angeles", "code"), ("Park", "Parkville", "no_rule"), ("NY City", "New York City", "abbreviated"), ("Stratford", "Stratford upon Avon", "no_rule"), ("Welly", "Wellington", "shortened"), ("Area51", "Area", "no_rule"),
], nm.classify_alias)
literal("x27_contains", [("Main Street", "MAIN", "true"), ("Main Street", "", "true"), ("Main", "Street", "false"), ("rue", "RUE ", "false")], nm.contains_ignoring_case)
literal("x32_address_keys", [("  12  Main\tSt ", "12 main st"), ("A", "a"), ("", "")], nm.address_key)
literal("x33_alpha2", [("AUS", "au"), ("gbr", "gb"), ("USA", "us"), ("XYZ", None), ("ZAF", "za")], nm.alpha2)
literal("x41_labels", [("Paris", "paris", "Île-de-France", "France", "Paris, Île-de-France, France"), ("Main St", None, "NSW", "Australia", "Main St, NSW, Australia"), ("Roma", "Roma", "Lazio", "Lazio", "Roma, Lazio"), ("X", "", "Y", None, "X, Y")], nm.label)
literal("j36_exonyms", [("München", None, "Munich"), ("München", "Munich (Bavaria)", None), ("Москва", None, "Moscow"), ("Springfield", None, None), ("Wien", "", "Vienna")], nm.exonym)
literal("x05_initials", [("n.y.c. road", "nyc road"), ("l.a", "la"), ("st. kilda", "st. kilda"), ("a.b.c.d", "abcd"), ("u.s. route 1", "us route 1")], tx.join_initials)
literal("x30_percent", [("a b&c", "a%20b%26c"), ("München", "M%C3%BCnchen"), ("x/y", "x%2Fy")], tx.percent_encode)
literal("x26_explains", [("new york city", "new york", "true"), ("new york", "new york city", "false"), ("york new", "new", "false"), ("perth", "perth", "true")], lambda a, b: tx.explains(F.split(a, " "), F.split(b, " ")))
literal("x03_leading_places", [("saint kilda", "st kilda"), ("mount eden", "mt eden"), ("fort worth", "ft worth"), ("main st", "main st"), ("ste marie", "st marie"), ("saint", "saint")], tx.key)
_CHAINS = [
    ("stripPunctuation", "St. John's, 5", "St Johns 5"), ("toLowerCase", "ABC", "abc"), ("toUpperCase", "abc", "ABC"), ("trim", "  a b ", "a b"), ("abbreviateDirectionals", "North Main northeast", "N Main NE"),
    ("abbreviateStreetSuffixes", "5th Avenue Road Waystreet", "5th AV RD Waystreet"), ("removeOrdinals", "1st 22ND x3rdy", "1 22 x3y"), ("removeNumbers", "12 Main 4", "Main"), ("abbreviateMountSaintFort", "Mount Saint Fort mounts", "Mt St Ft mounts"),
    ("toUpperCase+abbreviateStreetSuffixes+removeOrdinals", "5th avenue", "5 AV"), ("identity", "As Is", "As Is"),
]
literal("x29_normalizer_chains", _CHAINS, lambda chain, c: nm.normalize(c, F.split(chain, r"\+")))


_HIT = "named_struct('name', '{}', 'housenumber', '{}', 'unit', {}, 'suburb', 'Town', 'state', null, 'country_code', 'AU', 'postcode', '{}', 'lat', {}, 'lng', 151.0)"
_PAIRS = [
    (_HIT.format("Main  St", "1a", "'Unit 2'", "20 00", "-33.00001"), _HIT.format("main st", "1A", "'2'", "2000", "-33.00002"), True),
    (_HIT.format("Main St", "1", "null", "2000", "-33.0"), _HIT.format("Main St", "1", "null", "2000", "-33.001"), False),
    (_HIT.format("Main St", "1", "null", "2000", "-33.0"), _HIT.format("Main St", "2", "null", "2000", "-33.0"), False),
]


def _same(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(_PAIRS)).cast("int").alias("k"))
    side = lambda j: F.get(F.array(*[F.expr(c[j]) for c in _PAIRS]), F.col("k"))
    return p.select("id", side(0).alias("a"), side(1).alias("b")).select("id", nm.same_address(F.col("a"), F.col("b")).alias("same"))


Q["x32_same_address"] = _same
SQL["x32_same_address"] = f"select p_partkey as id, list_extract({[c[2] for c in _PAIRS]}, cast(p_partkey % {len(_PAIRS)} + 1 as bigint)) as same from part".replace("True", "true").replace("False", "false")


_TYPED = [
    ("12 Main St", "12|main|street"), ("St Kilda Rd", "st|kilda|road"), ("Jackson St SE", "jackson|street|se"), ("5th Ave, N.Y.C.", "5th|avenue|nyc"), ("Fifth Avenue", "5th|avenue"), ("twenty first st", "21st|street"),
    ("Mount Eden Rd", "mt|eden|road"), ("Dr Smith Dr", "doctor|smith|drive"), ("Café-Straße 3", "cafe|strasse|3"), ("Fort Worth, TX", "ft|worth|tx"),
]


def _tokens(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), F.get(F.array(*[F.lit(a) for a, _ in _TYPED]), (F.col("p_partkey") % len(_TYPED)).cast("int")).alias("q"))
    return tx.user_tokens(p, "id", "q").select("id", F.array_join("tokens", "|").alias("y"))


Q["x04_typed_words"] = _tokens
SQL["x04_typed_words"] = f"select p_partkey as id, list_extract([{', '.join(_sql(b) for _, b in _TYPED)}], cast(p_partkey % {len(_TYPED)} + 1 as bigint)) as y from part"


_ADDRESSES = [
    ("3/827a High St, Kew VIC 3101", "AU", "827a|3|3101|Victoria|high street kew"), ("12-14 George Street", "AU", "12-14||||george street"), ("#4 10 Main St Boston MA 02110", "US", "10|4|02110|Massachusetts|main st boston"),
    ("Unit 7 22 King Rd Otahuhu 1062", "NZ", "22|7|1062||king road otahuhu"), ("10 Downing Street London SW1A 2AA", "GB", "10||SW1A2AA||downing street london"), ("100 Queen St Toronto ON M5H 2N2", "CA", "100||M5H2N2|Ontario|queen st toronto"),
    ("5th Avenue New York", "US", "||||5th avenue new york"), ("Hauptstrasse 12", "DE", "12||||hauptstrasse"), ("Sydney", "AU", "||||sydney"),
]


def _parsed(spark, sf):
    p = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % len(_ADDRESSES)).cast("int").alias("k"))
    pick = lambda j: F.get(F.array(*[F.lit(c[j]) for c in _ADDRESSES]), F.col("k"))
    got = parse.freeform(p.select("id", pick(0).alias("q"), pick(1).alias("cc")), "id", "q", "cc")
    return got.select("id", F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("house", "unit", "postcode", "state", "rest")]).alias("y"))


Q["r21_parsed_addresses"] = _parsed
SQL["r21_parsed_addresses"] = f"select p_partkey as id, list_extract([{', '.join(_sql(c[2]) for c in _ADDRESSES)}], cast(p_partkey % {len(_ADDRESSES)} + 1 as bigint)) as y from part"
