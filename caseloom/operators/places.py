"""Regions and zips: expanding a region, and finding a place in free text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.blanks import ZIP_BLANKS, is_blank
from caseloom.functions.business import quote

UNKNOWN_ZIP = "99999"


def generic_zip(c: Column | str, last: int = 1) -> Column:
    """The last characters become X: one code for a whole city."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.substring(c, F.lit(1), F.length(c) - last), F.lit("X" * last))


def shown_name(key: Column | str) -> Column:
    """A city key as a user reads it: without its last part, words apart."""
    key = F.col(key) if isinstance(key, str) else key
    return F.replace(F.regexp_replace(key, "_[^_]*$", ""), F.lit("_"), F.lit(" "))


def _named(key: str, wanted: str) -> Column:
    """Named by its key, or by the key with words apart, or as ``region_options`` shows it."""
    return (F.col(key) == wanted) | (F.replace(key, F.lit("_"), F.lit(" ")) == wanted) | (shown_name(key) == wanted)


def region_zips(dim_city: DataFrame, dim_county: DataFrame, dim_state: DataFrame, state: str = "",
                county: str = "", city: str = "") -> DataFrame:
    """Zips of a state, county or city (the widest one given), each once, with a generic code per city.

    ``dim_state(state, county)``, ``dim_county(county, city_key)``,
    ``dim_city(city_key, city, zips array)``; a city's generic code comes from its last zip.
    A region the tables do not know has no zips.
    """
    if state:
        wanted = (dim_state.where((F.col("state") == state) | (F.replace("state", F.lit("_"), F.lit(" ")) == state)).join(dim_county, "county")
                  .select("city_key").distinct())
        cities = dim_city.join(wanted, "city_key", "left_semi")
    elif county:
        wanted = dim_county.where((F.col("county") == county) | (F.replace("county", F.lit("_"), F.lit(" ")) == county)).select("city_key").distinct()
        cities = dim_city.join(wanted, "city_key", "left_semi")
    elif city:
        cities = dim_city.where(_named("city_key", city))
    else:
        cities = dim_city
    own = F.array_append(F.col("zips"), generic_zip(F.element_at("zips", -1)))
    return cities.select(F.explode(own).alias("zip")).distinct()


def region_options(dim_city: DataFrame) -> DataFrame:
    """Names a user can pick from."""
    return dim_city.select(shown_name("city_key").alias("option")).distinct()


@dataclass(frozen=True)
class Place:
    """A name to look for and the code it stands for; earlier places win."""

    name: str
    code: str


def places_from(dim_city: DataFrame, only: DataFrame | None = None) -> list[Place]:
    """Places in dictionary order from ``dim_city(city, ord, zips)``, optionally a chosen subset.

    The names end up inside one pattern, so they are fetched to the driver; a city list is
    written by people and does not grow with the cases.
    """
    cities = dim_city if only is None else dim_city.join(only.select("city"), "city", "left_semi")
    coded = cities.select("ord", "city", generic_zip(F.element_at("zips", -1)).alias("code")).orderBy("ord")
    return [Place(r["city"].lower(), r["code"]) for r in coded.toLocalIterator()]


def _tree(names: list[str], edge: str) -> str:
    """One expression for many names that tries a letter once for all names that go on with it, longest names first."""
    root: dict = {}
    for name in names:
        node = root
        for letter in name:
            node = node.setdefault(letter, {})
        node[""] = {}

    def written(node: dict) -> str:
        ways = [quote(letter) + written(node[letter]) for letter in sorted(node) if letter]
        if "" in node:
            ways.append(edge)
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return written(root)


def _first_listed(names: list[str], whole_words: bool) -> list[int]:
    """For each distinct name the place in the list, from 1, of the earliest name that stands wherever it does: itself, or
    one that it begins with."""
    def word(letter: str) -> bool:
        return letter.isalnum() or letter == "_"

    at: dict[str, int] = {}
    for i, name in enumerate(names, 1):
        at.setdefault(name, i)
    return [min(at[name[:k]] for k in range(1, len(name) + 1) if name[:k] in at
                and (k == len(name) or not whole_words or word(name[k - 1]) != word(name[k]))) for name in at]


def place_in(c: Column | str, places: list[Place], whole_words: bool = True) -> Column:
    """Position of the earliest listed place found in the text, or null.

    A look-ahead finds the longest name at every position, from a tree of the names, so that ten times the names cost
    hardly more than the names themselves; which listed names it begins with is known beforehand, so "chino" is not
    lost inside "chino hills". The smallest position over all hits is the one a loop over the list would have stopped
    at. No join and no shuffle: the list is part of the expression.
    """
    c = F.trim(F.lower(F.col(c) if isinstance(c, str) else c))
    names = [p.name.lower() for p in places if p.name]
    ranks = [i for i, p in enumerate(places, 1) if p.name]
    if not names:
        return F.lit(None).cast("int")
    edge = r"\b" if whole_words else ""
    hits = F.regexp_extract_all(c, F.lit(f"(?={edge}({_tree(names, edge)}))"), F.lit(1))
    listed = F.array(*[F.lit(n) for n in dict.fromkeys(names)])
    first = F.array(*[F.lit(ranks[i - 1]) for i in _first_listed(names, whole_words)])
    return F.array_min(F.transform(hits, lambda hit: F.element_at(first, F.array_position(listed, hit).cast("int"))))


def infer_zip(df: DataFrame, places: list[Place], zip_col: str = "zip_cd", city: str = "cty_nm",
              trade: str = "trade_nm", legal: str = "legal_nm", address: str = "street_addr",
              jurisdiction: str = "juris_or_proj_nm",
              office: str = "Jurisdiction_region_or_General_Contractor",
              place_col: str | None = "inferred_city") -> DataFrame:
    """Fill a blank zip from the city, else the company names, address, and jurisdiction.

    Names and jurisdiction only count where the city is blank as well. Each source is one
    list scan: within a source the earlier place wins, and sources are tried in this order.
    """
    no_city = is_blank(city, ("",))
    either = F.least(place_in(trade, places), place_in(legal, places, whole_words=False))
    tail = [place_in(jurisdiction, places, whole_words=False)]
    if office in df.columns:
        tail.append(place_in(office, places))
    at = F.coalesce(
        place_in(city, places),
        F.when(no_city, either),
        place_in(address, places),
        F.when(no_city, F.least(*tail) if len(tail) > 1 else tail[0]))
    at = F.when(is_blank(zip_col, ZIP_BLANKS), at).cast("int")
    codes = F.array(*[F.lit(p.code) for p in places])
    names = F.array(*[F.lit(p.name) for p in places])
    out = df.withColumn("_at", at)
    filled = F.coalesce(F.when(F.col("_at").isNotNull(), F.element_at(codes, F.col("_at"))),
                        F.when(~is_blank(zip_col, ZIP_BLANKS), F.col(zip_col)), F.lit(UNKNOWN_ZIP))
    if place_col:
        out = out.withColumn(place_col, F.when(F.col("_at").isNotNull(), F.element_at(names, F.col("_at"))))
    return out.withColumn(zip_col, filled).drop("_at")
