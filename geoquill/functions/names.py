"""Names as Column functions: capitals, scripts, aliases, labels, acceptance normalizers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import bind, mapping, ordinal, postcode, unit_key

#: Street suffixes that open address files abbreviate in capitals.
CAPS_SUFFIXES = {
    "ST": "Street", "AVE": "Avenue", "AV": "Avenue", "BLVD": "Boulevard", "DR": "Drive", "RD": "Road", "LN": "Lane", "CT": "Court", "PL": "Place",
    "PKWY": "Parkway", "HWY": "Highway", "TER": "Terrace", "CIR": "Circle", "TRL": "Trail", "TR": "Trail", "SQ": "Square", "CRES": "Crescent",
    "EXPY": "Expressway", "FWY": "Freeway", "ALY": "Alley", "PLZ": "Plaza", "XING": "Crossing",
}
#: Directions that end a street, and those that open one, in full.
TRAILING = "N S E W NE NW SE SW".split()
LEADING = {"N": "North", "S": "South", "E": "East", "W": "West"}
#: Parts that stay in capitals.
KEPT_CAPS = "NE NW SE SW US II III IV".split()
#: Alias families by tag, in the order they are tried; the first is the name itself.
FAMILIES = "name official_name alt_name short_name old_name loc_name int_name reg_name ref int_ref nat_ref".split()
#: Words that an initialism must not be.
COMMON_WORDS = "a an and as at be by do go he if in is it me my no of oh ok on or so to up us we".split()
#: Three-letter country codes by their two-letter ones.
ALPHA3 = {
    "AUS": "au", "AUT": "at", "ARG": "ar", "BEL": "be", "BGR": "bg", "BRA": "br", "CAN": "ca", "CHE": "ch", "CHL": "cl", "CHN": "cn", "COL": "co", "CRI": "cr",
    "CZE": "cz", "DEU": "de", "DNK": "dk", "DOM": "do", "ECU": "ec", "EGY": "eg", "ESP": "es", "EST": "ee", "FIN": "fi", "FRA": "fr", "GBR": "gb", "GRC": "gr",
    "HKG": "hk", "HRV": "hr", "HUN": "hu", "IDN": "id", "IND": "in", "IRL": "ie", "IRN": "ir", "ISL": "is", "ISR": "il", "ITA": "it", "JAM": "jm", "JPN": "jp",
    "KEN": "ke", "KOR": "kr", "LKA": "lk", "LTU": "lt", "LUX": "lu", "LVA": "lv", "MAR": "ma", "MEX": "mx", "MYS": "my", "NGA": "ng", "NLD": "nl", "NOR": "no",
    "NZL": "nz", "PAK": "pk", "PER": "pe", "PHL": "ph", "POL": "pl", "PRT": "pt", "ROU": "ro", "RUS": "ru", "SAU": "sa", "SGP": "sg", "SVK": "sk", "SVN": "si",
    "SWE": "se", "THA": "th", "TUR": "tr", "TWN": "tw", "UKR": "ua", "URY": "uy", "USA": "us", "VEN": "ve", "VNM": "vn", "ZAF": "za",
}


def _capitalise(c: Column) -> Column:
    return F.concat(F.upper(F.left(c, F.lit(1))), F.lower(F.substr(c, F.lit(2))))


def _caps_part(p: Column) -> Column:
    tail = F.regexp_replace(p, "^[0-9]+", "")
    number = F.when(tail.isin("ST", "ND", "RD", "TH"), F.lower(p)).otherwise(p)
    quoted = F.concat(F.left(p, F.lit(2)), _capitalise(F.substr(p, F.lit(3))))
    return (
        F.when(p.rlike("^[0-9]"), number).when(p.isin(KEPT_CAPS), p)
        .when(p.rlike("^MC."), F.concat(F.lit("Mc"), _capitalise(F.substr(p, F.lit(3))))).when(p.rlike("^[^'].?'.") & p.rlike("^.'"), quoted).otherwise(_capitalise(p))
    )


def _caps_word(w: Column) -> Column:
    return F.array_join(F.transform(F.split(w, "-"), _caps_part), "-")


def all_caps(c: Column) -> Column:
    return c.rlike(r"\p{L}") & ~c.rlike(r"\p{Ll}")


def caps_name(c: Column) -> Column:
    """A city or unit in capitals with each word capitalised; other spellings stay."""
    return F.when(all_caps(c), F.array_join(F.transform(F.split(F.trim(c), r"\s+"), _caps_word), " ")).otherwise(c)


def caps_street(c: Column) -> Column:
    """A street in capitals, spelt out: its suffix in full, a number before it as an ordinal, a leading direction in full."""
    suffixes, leading = mapping(CAPS_SUFFIXES), mapping(LEADING)

    def spelt(raw: Column) -> Column:
        n = F.size(raw)
        at = F.when((n >= 2) & F.get(raw, n - 1).isin(TRAILING), n - 2).otherwise(n - 1)
        bare = F.regexp_replace(F.get(raw, at), r"\.+$", "")
        full = F.when(at > 0, F.try_element_at(suffixes, bare))
        before = F.get(raw, at - 1)
        number = F.when(full.isNotNull() & before.rlike("^[0-9]+$"), ordinal(before.try_cast("int")))
        first = F.when((at >= 1) & ~((at == 1) & full.isNotNull()), F.try_element_at(leading, F.get(raw, F.lit(0))))
        place = F.struct(at.alias("at"), full.alias("full"), number.alias("number"), first.alias("first"))
        word = lambda p: lambda w, i: F.coalesce(F.when(i == 0, p["first"]), F.when(i == p["at"], p["full"]), F.when(i == p["at"] - 1, p["number"]), _caps_word(w))
        return bind(place, lambda p: F.array_join(F.transform(raw, word(p)), " "))

    return F.when(all_caps(c), bind(F.split(F.trim(c), r"\s+"), spelt)).otherwise(c)


def _ranges(*pairs: tuple[int, int]) -> str:
    return "".join(f"\\x{{{a:04X}}}-\\x{{{b:04X}}}" for a, b in pairs)


#: Scripts by code point ranges.
SCRIPTS = {
    "cyrillic": _ranges((0x400, 0x52F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)), "greek": _ranges((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "han": _ranges((0x4E00, 0x9FFF), (0x3400, 0x4DBF), (0xF900, 0xFAFF)), "hiragana": _ranges((0x3040, 0x309F)), "katakana": _ranges((0x30A0, 0x30FF)),
    "hangul": _ranges((0xAC00, 0xD7AF)), "arabic": _ranges((0x600, 0x6FF), (0x750, 0x77F), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "hebrew": _ranges((0x590, 0x5FF), (0xFB1D, 0xFB4F)), "thai": _ranges((0xE00, 0xE7F)), "devanagari": _ranges((0x900, 0x97F)),
}


def script_of(c: Column) -> Column:
    """The script of the first letter outside Latin, or "latin"."""
    first = F.regexp_extract(c, "[" + "".join(SCRIPTS.values()) + "]", 0)
    out = F.when(first == "", "latin")
    for name, chars in SCRIPTS.items():
        out = out.when(first.rlike(f"[{chars}]"), name)
    return out.otherwise("latin")


#: Latin spellings of Cyrillic and Greek letters as maps of English-language gazetteers give them.
CYRILLIC = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґ", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya i yi ye g".split(" "), strict=True))
GREEK = dict(zip("αβγδεζηθικλμνξοπρσςτυφχψωάέήίόύώϊϋ", "a v g d e z i th i k l m n x o p r s s t y f ch ps o a e i i o y o i y".split(" "), strict=True))
#: Romanised leads, vowels and tails of Korean syllables, in the order of the code block.
LEADS = "g kk n d tt r m b pp s ss  j jj ch k t p h".split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split(" ")
TAILS = " k k k n n n t l k m l l l p l m p p t t ng t t k t p t".split(" ")


def _kana() -> dict[str, str]:
    """Hiragana by rule: rows of consonants along the vowels, each with its voiced forms, and the irregular spellings."""
    odd = {"si": "shi", "ti": "chi", "tu": "tsu", "hu": "fu", "zi": "ji", "di": "ji", "du": "zu"}
    out, code = {}, 0x3042
    for v in "aiueo":
        out[chr(code)] = v
        code += 2
    code -= 1
    for row in ("kg", "sz", "td"):
        for v in "aiueo":
            if row + v == "tdu":
                code += 1  # the small tsu
            for c in row:
                out[chr(code)] = odd.get(c + v, c + v)
                code += 1
    for v in "aiueo":
        out[chr(code)] = "n" + v
        code += 1
    for v in "aiueo":
        for c in "hbp":
            out[chr(code)] = odd.get(c + v, c + v)
            code += 1
    for v in "aiueo":
        out[chr(code)] = "m" + v
        code += 1
    for v in "auo":
        out[chr(code + 1)] = "y" + v
        code += 2
    for v in "aiueo":
        out[chr(code)] = "r" + v
        code += 1
    return out | {"わ": "wa", "を": "o", "ん": "n", "ー": ""}


KANA = _kana()


def _letters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def _spell(c: Column, table: dict[str, str]) -> Column:
    """Letter by letter; a capital's spelling begins with a capital, what the table lacks stays."""
    known = mapping(table)

    def one(ch: Column) -> Column:
        low = F.try_element_at(known, F.lower(ch))
        return F.coalesce(F.when((ch != F.lower(ch)) & low.isNotNull(), _capitalise(low)), low, ch)

    return F.array_join(F.transform(_letters(c), one), "")


def transliterate(c: Column) -> Column:
    """Latin spellings of a name: Cyrillic, Greek, kana and Korean; an empty array for Latin and the scripts not covered
    (Han, Arabic, Hebrew, Thai, Devanagari need dictionaries or vowels that the writing leaves out)."""
    script = script_of(c)
    low = F.translate(c, "".join(chr(k) for k in range(0x30A1, 0x30F7)), "".join(chr(k - 0x60) for k in range(0x30A1, 0x30F7)))
    code = lambda ch: F.when(ch.rlike(r"[\x{AC00}-\x{D7A3}]"), F.ascii(ch) - 0xAC00)
    pick = lambda words, k: F.get(F.array(*map(F.lit, words)), k.cast("int"))
    syllable = lambda ch: bind(code(ch), lambda k: F.when(k.isNull(), ch).otherwise(F.concat(pick(LEADS, F.floor(k / 588)), pick(VOWELS, F.floor(k % 588 / 28)), pick(TAILS, k % 28))))
    korean = F.transform(_letters(c), syllable)
    sounds = F.regexp_replace(_spell(low, KANA), "っ([a-z])", "$1$1")
    for small, vowel in (("ゃ", "a"), ("ゅ", "u"), ("ょ", "o")):
        sounds = F.regexp_replace(F.regexp_replace(sounds, f"(sh|ch|j)i{small}", f"$1{vowel}"), f"i{small}", f"y{vowel}")
    kana = F.when(script.isin("hiragana", "katakana"), F.array(sounds))
    hangul = F.when(script == "hangul", F.array_distinct(F.array(F.regexp_replace(F.array_join(korean, " "), r"\s+", " "), F.array_join(korean, ""))))
    return F.coalesce(F.when(script == "cyrillic", F.array(_spell(c, CYRILLIC))).when(script == "greek", F.array(_spell(c, GREEK))), kana, hangul, F.array().cast("array<string>"))


def pack_language(c: Column) -> Column:
    """Two letters of a language tag as a number, 0 where it is none; a region or script may follow behind a dash."""
    ok = F.lower(c).rlike(r"^[a-z]{2}(?:-..+)?$")
    return F.when(ok, F.ascii(F.lower(c)) + F.ascii(F.substr(F.lower(c), F.lit(2))) * 256).otherwise(0)


def alias_rows(tags: Column) -> Column:
    """Aliases (family, lang, alias) of a tag map: language variants of every family, alternates split at semicolons.

    The bare name is not an alias; its left and right sides are alternates of no language.
    """
    shape = "^(" + "|".join(sorted(FAMILIES, key=len, reverse=True)) + ")(?::(.*))?$"

    def rows(e: Column) -> Column:
        family, tail = F.regexp_extract(e["key"], shape, 1), F.regexp_extract(e["key"], shape, 2)
        side = (family == "name") & tail.isin("left", "right")
        lang = F.when(side | (tail == ""), 0).otherwise(pack_language(tail))
        keep = (family != "") & (e["value"] != "") & ~((family == "name") & (tail == "")) & (side | (tail == "") | (lang != 0))
        kind = F.when(side, "alt_name").otherwise(family)
        values = F.when((family == "alt_name"), F.filter(F.transform(F.split(e["value"], ";"), lambda v: F.trim(v)), lambda v: v != "")).otherwise(F.array(e["value"]))
        return F.when(keep, F.transform(values, lambda v: F.struct(kind.alias("family"), lang.alias("lang"), v.alias("alias"))))

    found = F.filter(F.transform(F.map_entries(tags), rows), lambda x: x.isNotNull())
    return F.array_sort(F.array_distinct(F.flatten(found)))


def tidy_alias(c: Column) -> Column:
    """Dots gone, white space single, initials joined: "N.Y.C." to "NYC", "S. Fran" to "S Fran"."""
    words = F.filter(F.split(F.trim(F.replace(c, F.lit("."), F.lit(". "))), r"\s+"), lambda w: F.regexp_replace(w, r"\.+$", "") != "")
    initial = lambda w: w.rlike(r"^[A-Z]\.$")
    joined = lambda ws: F.transform(ws, lambda w, i: F.concat(F.when((i == 0) | (initial(w) & initial(F.coalesce(F.get(ws, F.greatest(i - 1, F.lit(0))), F.lit("")))), F.lit("")).otherwise(" "), F.regexp_replace(w, r"\.+$", "")))
    return bind(words, lambda ws: F.array_join(joined(ws), ""))


def _compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))


def _initials(ws: Column) -> Column:
    return F.upper(F.array_join(F.transform(ws, lambda w: F.left(w, F.lit(1))), ""))


def _abbreviates(alias: Column, name: Column) -> Column:
    """Each alias word is the name's, a prefix of three letters that drops three, or capital initials of the next words."""
    start = F.struct(F.lit(0).alias("at"), F.lit(False).alias("kept"), F.lit(False).alias("short"), F.lit(True).alias("ok"))

    def step(s: Column, w: Column) -> Column:
        target, n = F.coalesce(F.get(name, s["at"]), F.lit("")), F.length(w)
        same = F.lower(w) == F.lower(target)
        capitals = w.rlike("^[A-Z]{2,}$") & (s["at"] + n <= F.size(name)) & (_initials(F.slice(name, s["at"] + 1, n)) == w)
        prefix = (n >= 3) & (n + 3 <= F.length(target)) & F.startswith(F.lower(target), F.lower(w))
        go = s["ok"] & (target != "") & (same | capitals | prefix)
        width = F.when(same, 1).when(capitals, n).otherwise(1)
        return F.struct((s["at"] + F.when(go, width).otherwise(0)).alias("at"), (s["kept"] | (go & same)).alias("kept"), (s["short"] | (go & ~same)).alias("short"), go.alias("ok"))

    return F.aggregate(alias, start, step, lambda s: s["ok"] & s["kept"] & s["short"] & (s["at"] == F.size(name)) & (F.size(alias) >= 2))


def _shortens(alias: Column, name: Column, words: Column) -> Column:
    """One word that keeps four letters or more of the name and adds y, ie or o, the last letter doubled or not."""
    a, full = F.lower(alias), _compact(name)
    stem = lambda k: F.left(a, F.length(a) - k)
    cut = lambda end, twice: F.endswith(a, F.lit(end)) & _keeps(a, full, len(end), twice)

    def _keeps(x: Column, whole: Column, k: int, twice: bool) -> Column:
        body = stem(k)
        body = F.left(body, F.length(body) - 1) if twice else body
        doubled = F.right(body, F.lit(1)) == F.right(stem(k), F.lit(1)) if twice else F.lit(True)
        # the ending must not go on with the name's own letters, or the common part would be longer
        more = F.substr(whole, F.length(body) + 1, F.lit(1)) != F.substr(x, F.length(body) + 1, F.lit(1))
        return (F.length(body) >= 4) & F.startswith(whole, body) & doubled & more

    ok = a.rlike(r"^\p{L}+$") & (F.length(a) < F.length(full)) & ~F.exists(words, lambda w: F.lower(w) == a)
    ends = [cut(e, t) for e in ("y", "ie", "o") for t in (False, True)]
    any_end = ends[0]
    for e in ends[1:]:
        any_end = any_end | e
    return ok & any_end


def classify_alias(alias: Column, name: Column) -> Column:
    """The rule that keeps a tidied alias of a name (initialism, compact, abbreviated, shortened) or why it is dropped
    (leading_the, common_word, code, no_rule)."""
    words = F.filter(F.transform(F.split(name, r"[\s-]"), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}]", "")), lambda w: w != "")

    def rule(ws: Column) -> Column:
        upper, several = alias.rlike("^[A-Z]+$"), F.size(ws) >= 2
        init = _initials(ws)
        aw = F.split(alias, " ")
        initialism = several & upper & (F.length(alias) >= 2) & ((alias == init) | (alias == F.concat(init, F.lit("C"))))
        return (
            F.when(F.startswith(F.lower(alias), F.lit("the ")), "leading_the").when(F.lower(alias).isin(COMMON_WORDS), "common_word").when(alias.rlike("[0-9]"), "no_rule")
            .when(initialism, "initialism").when(several & alias.rlike(r"^\p{L}+$") & (_compact(alias) == _compact(name)), "compact")
            .when(_abbreviates(aw, ws), "abbreviated").when((F.size(aw) == 1) & _shortens(alias, name, ws), "shortened")
            .when(upper & F.length(alias).between(3, 5), "code").otherwise("no_rule")
        )

    return bind(words, rule)


def contains_ignoring_case(text: Column, part: Column) -> Column:
    """Substring test with A-Z as a-z; an empty part is in every text."""
    return F.contains(F.lower(text), F.lower(part))


def address_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), r"\s+", " "))


def same_address(a: Column, b: Column) -> Column:
    """Whether two hits (name, housenumber, unit, suburb, state, country_code, postcode, lat, lng) are one address."""
    text = [address_key(a[f]) == address_key(b[f]) for f in ("name", "housenumber", "suburb", "state", "country_code")]
    near = [F.round(a[f] * 10000) == F.round(b[f] * 10000) for f in ("lat", "lng")]
    unit = unit_key(F.coalesce(a["unit"], F.lit(""))) == unit_key(F.coalesce(b["unit"], F.lit("")))
    code = postcode(F.coalesce(a["postcode"], F.lit(""))) == postcode(F.coalesce(b["postcode"], F.lit("")))
    out = unit & code
    for t in (*text, *near):
        out = out & t
    return out


def alpha2(c: Column) -> Column:
    """The two-letter code of a three-letter one, or null."""
    return F.try_element_at(mapping(ALPHA3), F.upper(c))


def label(name: Column, *context: Column) -> Column:
    """A name with its context behind commas; what repeats an earlier part, in any case, or is empty is left out."""
    parts = F.filter(F.array(name, *context), lambda p: p.isNotNull() & (p != ""))
    seen = lambda ps: F.filter(ps, lambda p, i: F.array_position(F.transform(ps, F.lower), F.lower(p)) == i + 1)
    return F.array_join(bind(parts, seen), ", ")


#: Terms of the acceptance normalizers, in the order they are replaced.
DIRECTION_TERMS = [("NORTH", "N"), ("SOUTH", "S"), ("EAST", "E"), ("WEST", "W"), ("NORTHEAST", "NE"), ("NORTHWEST", "NW"), ("SOUTHEAST", "SE"), ("SOUTHWEST", "SW")]
SUFFIX_TERMS = [
    ("AVE", "AV"), ("AVENUE", "AV"), ("BOULEVARD", "BLVD"), ("CIRCLE", "CIR"), ("COURT", "CT"), ("COVE", "CV"), ("DRIVE", "DR"), ("HIGHWAY", "HWY"), ("JUNIOR", "JR"),
    ("LANE", "LN"), ("LOOP", "LP"), ("PARKWAY", "PKWY"), ("PIKE", "PKE"), ("PLACE", "PL"), ("ROAD", "RD"), ("STREET", "ST"), ("TERR", "TER"), ("TERRACE", "TER"),
    ("TRACE", "TRCE"), ("WAY", "WY"),
]
PLACE_TERMS = [("MOUNT", "Mt"), ("SAINT", "St"), ("FORT", "Ft")]


def _terms(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for term, short in pairs:
        c = F.regexp_replace(c, rf"(?i)(?<![A-Za-z0-9_]){term}(?![A-Za-z0-9_])", short)
    return c


NORMALIZERS = {
    "identity": lambda c: c,
    "stripPunctuation": lambda c: F.regexp_replace(c, r"[^A-Za-z0-9_\s ﻿]", ""),
    "toLowerCase": F.lower,
    "toUpperCase": F.upper,
    "trim": lambda c: F.regexp_replace(c, r"^[\s ﻿]+|[\s ﻿]+$", ""),
    "abbreviateDirectionals": lambda c: _terms(c, DIRECTION_TERMS),
    "abbreviateStreetSuffixes": lambda c: _terms(c, SUFFIX_TERMS),
    "removeOrdinals": lambda c: F.regexp_replace(c, "([0-9]+)(?i:st|nd|th|rd)", "$1"),
    "removeNumbers": lambda c: F.regexp_replace(F.regexp_replace(c, "[0-9]", ""), r"^\s+|\s+$", ""),
    "abbreviateMountSaintFort": lambda c: _terms(c, PLACE_TERMS),
}


def normalize(c: Column, chain: Column) -> Column:
    """A text through a chain (array of names) of acceptance normalizers; unknown names change nothing."""

    def step(text: Column, name: Column) -> Column:
        out = F.when(name == "identity", text)
        for k, f in NORMALIZERS.items():
            out = out.when(name == k, f(text))
        return out.otherwise(text)

    return F.aggregate(F.coalesce(chain, F.array().cast("array<string>")), c, step)


#: English names of places whose own name gives no hint of them.
EXONYMS = {
    "München": "Munich", "Köln": "Cologne", "Wien": "Vienna", "Nürnberg": "Nuremberg", "Hannover": "Hanover", "Braunschweig": "Brunswick",
    "Aachen": "Aachen", "Roma": "Rome", "Milano": "Milan", "Napoli": "Naples", "Firenze": "Florence", "Venezia": "Venice", "Torino": "Turin",
    "Genova": "Genoa", "Padova": "Padua", "Siracusa": "Syracuse", "Livorno": "Leghorn", "Sevilla": "Seville", "Lisboa": "Lisbon",
    "A Coruña": "Corunna", "Donostia / San Sebastián": "San Sebastian", "Warszawa": "Warsaw", "Kraków": "Krakow", "Wrocław": "Wroclaw",
    "Gdańsk": "Gdansk", "Łódź": "Lodz", "Poznań": "Poznan", "Praha": "Prague", "Plzeň": "Pilsen", "București": "Bucharest", "София": "Sofia",
    "Београд": "Belgrade", "Tiranë": "Tirana", "Москва": "Moscow", "Санкт-Петербург": "Saint Petersburg", "Екатеринбург": "Yekaterinburg",
    "Нижний Новгород": "Nizhny Novgorod", "Новосибирск": "Novosibirsk", "Казань": "Kazan", "Київ": "Kyiv", "Львів": "Lviv", "Одеса": "Odesa",
    "Харків": "Kharkiv", "Дніпро": "Dnipro", "Αθήνα": "Athens", "Θεσσαλονίκη": "Thessaloniki", "İstanbul": "Istanbul", "İzmir": "Izmir",
    "القاهرة": "Cairo", "الإسكندرية": "Alexandria", "الخرطوم": "Khartoum", "دمشق": "Damascus", "بغداد": "Baghdad", "الرياض": "Riyadh",
    "مكة المكرمة": "Mecca", "المدينة المنورة": "Medina", "الدوحة": "Doha", "بيروت": "Beirut", "عمّان": "Amman", "تهران": "Tehran",
    "اصفهان": "Isfahan", "شیراز": "Shiraz", "مشهد": "Mashhad", "تبریز": "Tabriz", "東京": "Tokyo", "京都": "Kyoto", "大阪": "Osaka", "横浜": "Yokohama",
    "札幌": "Sapporo", "名古屋": "Nagoya", "北京": "Beijing", "上海": "Shanghai", "广州": "Guangzhou", "深圳": "Shenzhen", "成都": "Chengdu", "重庆": "Chongqing",
    "杭州": "Hangzhou", "南京": "Nanjing", "西安": "Xi'an", "天津": "Tianjin", "서울": "Seoul", "부산": "Busan", "인천": "Incheon",
}


def exonym(name: Column, name_en: Column) -> Column:
    """The English name of a place that has no English tag of its own, or null."""
    return F.when(name_en.isNull() | (name_en == ""), F.try_element_at(mapping(EXONYMS), name))


#: Street types that query variants abbreviate.
VARIANT_SUFFIXES = {
    "street": "St", "road": "Rd", "avenue": "Ave", "boulevard": "Blvd", "drive": "Dr", "lane": "Ln", "court": "Ct", "place": "Pl", "terrace": "Tce", "highway": "Hwy", "parkway": "Pkwy", "close": "Cl",
}


def query_variants(number: Column, street: Column, city: Column) -> Column:
    """Array of (variant, q) for an address: free form, with its street type abbreviated, and with the middle letter gone
    from its first word of five letters or more that is no street type. What changes nothing is left out."""
    line = lambda s: F.concat(F.concat_ws(" ", number, s), F.lit(", "), city)
    short = street
    for word, abbreviation in VARIANT_SUFFIXES.items():
        short = F.regexp_replace(short, rf"(?i)\b{word}\b", abbreviation)
    long = r"\b(?!(?i:" + "|".join(VARIANT_SUFFIXES) + r")\b)([A-Za-z]{5,})\b"
    word = F.regexp_extract(street, long, 1)
    at = F.instr(street, word)
    cut = at + F.floor(F.length(word) / 2).cast("int")
    typo = F.when(word != "", F.concat(F.substr(street, F.lit(1), cut - 1), F.substr(street, cut + 1)))
    each = [F.struct(F.lit(v).alias("variant"), line(s).alias("q")) for v, s in (("freeform", street), ("abbreviation", F.when(short != street, short)), ("typo", typo))]
    return F.filter(F.array(*each), lambda x: x["q"].isNotNull())
