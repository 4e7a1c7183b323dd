"""Names, house numbers, classes and tags as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Class names of the cadastre by their letter, the patterns of its two short spellings, and life-cycle keys in order of priority.
CLASS_PREFIXES = {
    "budynki mieszkalne": "m", "budynki biurowe": "b", "budynki handlowo-usługowe": "h", "budynki przemysłowe": "p", "budynki transportu": "t", "budynki szpitali": "z", "budynki oświaty": "k", "budynki produkcyjne": "g",
    "zbiorniki, silosy": "s", "pozostałe budynki niemieszkalne": "i",
}
CLASS_NAMES = {
    "mieszkalny": "m", "budynekmieszkalny": "m", "biurowy": "b", "handlowouslugowy": "h", "przemyslowy": "p", "transportuilacznosci": "t", "szpitalaiinnebudynkiopiekizdrowotnej": "z", "oswiatynaukiikulturyorazsportu": "k",
    "produkcyjnyuslugowyigospodarczy": "g", "zbiorniksilosibudynekmagazynowy": "s", "budynekniemieszkalny": "i",
}
CLASS_WITH_NUMBER, CLASS_SHORT = r"^[a-z] - .* \(\d+\)$", r"^[mgithpskbz][a-z]?[0-9]?\.?$"
LIFECYCLE_KEYS = ["demolished:building", "destroyed:building", "abandoned:building", "was:building", "razed:building", "removed:building", "disused:building", "ruins:building"]


def norm_name(c: Column) -> Column:
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def norm_housenumber(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(F.translate(c, "\\-", "//"))), r"^(\d{1,2}) ([A-Za-z])$", "$1$2")


def strip_street_prefix(c: Column) -> Column:
    """Without "ulica" or "ul." at the very start, if white space and something else follow."""
    return F.regexp_replace(c, r"(?i)^(?:ulica|ul\.)\s+(?=\S)", "")


def class_code(c: Column) -> Column:
    """The letter of a cadastre class: of a numbered entry, a long or a joined name, or a letter with what may follow it; null for others."""
    s = F.lower(F.trim(c))
    out = F.when(s.rlike(CLASS_WITH_NUMBER), F.substring(s, 1, 1))
    for prefix, code in CLASS_PREFIXES.items():
        out = out.when(F.startswith(s, F.lit(prefix)), code)
    for name, code in CLASS_NAMES.items():
        out = out.when(s == name, code)
    return out.when(s.rlike(CLASS_SHORT), F.substring(s, 1, 1))


def parse_tags(c: Column) -> Column:
    """k=v;k=v as a map, null if a part is malformed (no key, no value, or no "=")."""
    parts = F.transform(F.split(c, ";"), lambda p: F.trim(p))
    good = F.forall(parts, lambda p: p.rlike(r"^[^=\s][^=]*=.*\S"))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^=]*=", "")).alias("value")))
    whole = good & (F.size(F.array_distinct(F.transform(pairs, lambda p: p.key))) == F.size(pairs))
    return F.when(whole, F.map_from_entries(F.when(whole, pairs)))


def lifecycle_key(tags: Column) -> Column:
    """The first life-cycle key that the tags hold, unless there is a standing building."""
    return F.when(~F.coalesce(F.map_contains_key(tags, "building"), F.lit(False)), F.coalesce(*(F.when(F.map_contains_key(tags, k), F.lit(k)) for k in LIFECYCLE_KEYS)))


def city_of(tags: Column) -> Column:
    return F.coalesce(F.element_at(tags, "addr:city"), F.element_at(tags, "addr:place"))


def address_tags(housenumber: Column, street: Column, city: Column, postcode: Column, settlement: Column, source: str) -> Column:
    """Map tags of an address: with a street its settlement is the city, without one the place."""
    own = lambda c: F.nullif(F.trim(c), F.lit(""))
    keys = ["addr:housenumber", "addr:street", "addr:city", "addr:place", "addr:postcode", "addr:city:simc", "source:addr"]
    values = [own(housenumber), own(street), F.when(own(street).isNotNull(), own(city)), F.when(own(street).isNull(), own(city)), own(postcode), own(settlement), F.lit(source)]
    return F.map_filter(F.map_from_arrays(F.array(*map(F.lit, keys)), F.array(*values)), lambda k, v: v.isNotNull())


def levels_text(levels: Column) -> Column:
    return F.when(levels >= 1, levels.cast("string"))


def building_tags(tags: Column, levels: Column, source: str) -> Column:
    """Resolved tags or building=yes, with the storeys (if there are any) and the source in place of the same tags of the mapping."""
    base = F.coalesce(tags, F.create_map(F.lit("building"), F.lit("yes")))
    more = F.map_filter(F.map_from_arrays(F.array(F.lit("building:levels"), F.lit("source:building")), F.array(levels_text(levels), F.lit(source))), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.map_contains_key(more, k)), more)


def signature(*columns: Column) -> Column:
    """A stored md5 of compared columns: null is a character of its own, so are the joints."""
    return F.md5(F.concat_ws("\x1f", *(F.coalesce(c.cast("string"), F.lit("\x1e")) for c in columns)))


def content_hash(*columns: Column) -> Column:
    """A 64-bit hash for one comparison; nulls count and keep their place."""
    return F.xxhash64(F.to_json(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))), {"ignoreNullFields": "false"}))


def member_role(role: Column) -> Column:
    r = F.lower(F.trim(F.coalesce(role, F.lit(""))))
    return F.when(r.isin("", "outer"), "outer").when(r == "inner", "inner").otherwise("other")


def utc_iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
