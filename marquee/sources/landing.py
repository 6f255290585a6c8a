"""Landed JSON of the three sources as listings."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marquee.functions.text import has, or_else, trimmed
from marquee.operators.classify import valid_tag
from marquee.operators.listings import not_blacklisted
from marquee.schema import LISTING_JSON, MAINLAND, SIMPLIFIED

#: Node type of a listing in source A's tree.
LISTING_NODE = "7587"


def read_listings(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Files of JSON arrays of listings."""
    return spark.read.schema(LISTING_JSON).option("multiLine", True).json(paths).withColumnRenamed("updatedAt", "updated_at")


def unwrap_jsonp(body: Column) -> Column:
    """The JSON between the first and the last parenthesis of a callback; null if it is none."""
    return F.try_parse_json(F.nullif(F.regexp_extract(body, r"(?s)^[^(]*\((.*)\)[^)]*$", 1), F.lit("")))


def flatten_tree(trees: DataFrame, depth: int = 100) -> DataFrame:
    """tree_id, path, type, data, node of every node below the roots of ``trees`` (tree_id, body).

    ``body`` is JSON text {"nodes": [...]}; what is no such text has no nodes.  Order by tree_id, path for the
    order of a walk that gives a node before its children.  Trees are read once, whatever their depth: each row is
    walked level by level where it lies.  A task holds the levels of one body at a time, so land trees in parts of a
    bounded size, which may share a tree_id.  A node deeper than ``depth`` is an error when the rows are made.
    """
    none = F.array().cast("array<struct<path: array<int>, node: variant>>")
    start = F.struct(F.array().cast("array<int>").alias("path"), F.try_parse_json("body").alias("node"))

    def children(parent: Column) -> Column:
        nodes = F.try_variant_get(parent["node"], "$.nodes", "array<variant>")
        return F.coalesce(F.transform(nodes, lambda n, at: F.struct(F.concat(parent["path"], F.array(at)).alias("path"), n.alias("node"))), none)

    def deeper(walk: Column, _: Column) -> Column:
        level = F.flatten(F.transform(walk["level"], children))
        return F.when(F.size(walk["level"]) == 0, walk).otherwise(F.struct(F.concat(walk["above"], F.array(walk["level"])).alias("above"), level.alias("level")))

    def all_levels(walk: Column) -> Column:
        return F.when(F.size(walk["level"]) > 0, F.raise_error(F.lit(f"a tree is deeper than {depth}"))).otherwise(F.flatten(F.slice(walk["above"], 2, depth)))

    begin = F.struct(F.array().cast("array<array<struct<path: array<int>, node: variant>>>").alias("above"), F.array(start).alias("level"))
    found = F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(depth + 1)), begin, deeper, all_levels)).alias("x")
    nodes = trees.select("tree_id", found).select("tree_id", "x.path", "x.node")
    return nodes.select("tree_id", "path", F.try_variant_get("node", "$.type", "string").alias("type"), F.try_variant_get("node", "$.data", "variant").alias("data"), "node")


def _field(name: str) -> Column:
    return F.try_variant_get("data", f"$.{name}", "string")


def _first(default, *names: str) -> Column:
    """The first of some fields that is neither absent nor empty."""
    return or_else(F.coalesce(*[F.nullif(_field(n), F.lit("")) for n in names]), default)


def listing_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.filter((F.col("type") == LISTING_NODE) & or_else(_field("itemId"), or_else(_field("id"), F.lit(None).cast("string"))).isNotNull())


def find_keyword(nodes: DataFrame, keyword: str) -> DataFrame:
    """The nodes with a keyword and ``is_listing``: listings with it in their title, and others with it anywhere in them or below."""
    is_listing = (F.col("type") == LISTING_NODE) & F.col("data").isNotNull()
    title = _first("", "name", "showTag", "projectName")
    hit = F.when(F.coalesce(is_listing, F.lit(False)), F.contains(title, F.lit(keyword))).otherwise(F.contains(F.to_json("node"), F.lit(keyword)))
    return nodes.filter(hit).withColumn("is_listing", F.coalesce(is_listing, F.lit(False)))


def project_a(nodes: DataFrame) -> DataFrame:
    """Listings of source A's nodes (data: variant).  Without a tag an artist passes for famous, as in a listing that does not say."""
    tag = _field("showTag")
    return nodes.select(
        _first("", "id", "itemId").alias("id"),
        _first("", "name", "showTag", "projectName").alias("title"),
        _first("", "verticalPic").alias("image"),
        _first("", "showTime").alias("date"),
        trimmed(_first("", "cityName")).alias("city"),
        _first("", "venueName").alias("venue"),
        _first("Pending", "priceShowText", "priceStr", "priceLow").alias("price"),
        _first("Unknown", "showStatus.desc").alias("status"),
        _first("Concert", "topRight.tag").alias("category"),
        F.when(valid_tag(tag), tag).otherwise("").alias("artist"),
        F.when(has(tag), valid_tag(tag)).otherwise(True).alias("is_famous"),
    )


def project_b(items: DataFrame) -> DataFrame:
    """Listings of source B's items (one struct column's fields at top level)."""
    artist = F.get(F.filter("tags", lambda t: t["tagType"] == "ARTIST"), 0)["tagName"]
    price = F.concat(F.coalesce("priceInfo.prefix", F.lit("")), F.coalesce("priceInfo.yuanNum", F.lit("")), F.coalesce("priceInfo.suffix", F.lit("")))
    return items.select(
        F.concat(F.lit("mt_"), "showId").alias("id"),
        F.col("showName").alias("title"),
        F.lit("").alias("image"),
        or_else("showDate", "").alias("date"),
        or_else("showCity", or_else("cityName", "")).alias("city"),
        or_else("venueName", "").alias("venue"),
        F.when(F.col("priceInfo").isNull(), "价格待定").otherwise(price).alias("price"),
        or_else("showStatusDisplayName", "销售中").alias("status"),
        F.lit("演唱会").alias("category"),
        F.coalesce(artist, F.lit("")).alias("artist"),
    )


def first_day(text: Column) -> Column:
    """Left of ' - ', with dots for slashes, cut to yyyy.MM.dd where it has one."""
    dotted = F.replace(F.split_part(F.coalesce(text, F.lit("")), F.lit(" - "), F.lit(1)), F.lit("/"), F.lit("."))
    return or_else(F.regexp_extract(dotted, r"([0-9]{4}\.[0-9]{2}\.[0-9]{2})", 1), dotted)


def simplified(text: Column, pairs: dict[str, str] = SIMPLIFIED) -> Column:
    """Character by character by a table; ``phrases`` makes a converter of a dictionary."""
    return F.translate(text, "".join(pairs), "".join(pairs.values()))


def longest_matches(pairs: dict[str, str]) -> Callable[[str], str]:
    """Replaces, from left to right, the longest key that begins at a place, and goes on behind it; other characters stay."""
    lengths: dict[str, list[int]] = {}
    for size, first in sorted({(len(key), key[0]) for key in pairs}, reverse=True):
        lengths.setdefault(first, []).append(size)
    begins = re.compile("[" + re.escape("".join(lengths)) + "]") if lengths else re.compile(r"(?!)")

    def convert(text: str) -> str:
        out, done, at = [], 0, begins.search(text)
        while at:
            start = at.start()
            key = next((text[start : start + n] for n in lengths[text[start]] if text[start : start + n] in pairs), None)
            if key is not None:
                out += (text[done:start], pairs[key])
                done = start + len(key)
            at = begins.search(text, done if key is not None else start + 1)
        return "".join(out) + text[done:]

    return convert


def phrases(dictionary: DataFrame, characters: dict[str, str] = SIMPLIFIED, limit: int = 200_000) -> Callable[[Column], Column]:
    """A converter for ``project_c`` that takes the longest phrase of ``dictionary`` (phrase, simplified) at each place, or else the character.

    The dictionary goes to every task, so more than ``limit`` different phrases are an error.  Of entries of one phrase the least
    conversion counts; entries with a null, and an empty phrase, count as none.  A null text stays null.
    """
    entries = dictionary.filter("phrase <> '' AND simplified IS NOT NULL").groupBy("phrase").agg(F.min("simplified").alias("simplified"))
    rows = entries.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"the dictionary has more than {limit} phrases")
    convert = longest_matches(characters | {r.phrase: r.simplified for r in rows})

    @F.pandas_udf("string")
    def by_phrase(texts: pd.Series) -> pd.Series:
        return texts.map(convert, na_action="ignore")

    return by_phrase


def project_c(items: DataFrame, convert: Callable[[Column], Column] = simplified) -> DataFrame:
    """Listings of source C's items; ``convert`` maps a column from traditional to simplified characters."""
    return items.select(
        F.concat(F.lit("mtglobal_"), "id").alias("id"),
        convert(or_else("title", "")).alias("title"),
        or_else("imgUrl", "").alias("image"),
        first_day(F.col("showDate")).alias("date"),
        convert(or_else("location", or_else("locationName", ""))).alias("city"),
        convert(or_else("venueName", "")).alias("venue"),
        or_else("salePrice", "Pending").alias("price"),
        F.when(F.col("status") == "ONSALE", "销售中").otherwise(or_else("status", "Unknown")).alias("status"),
        F.lit("演唱会").alias("category"),
        F.lit("").alias("artist"),
    )


def read_pages(spark: SparkSession, schema: str, paths: str | list[str]) -> DataFrame:
    """Landed pages, one JSON document a file, by one of the schemas PAGE_B, PAGE_C, CITIES_A, CITIES_B and LOCATIONS_C."""
    return spark.read.schema(schema).option("multiLine", True).json(paths)


def listings_b(pages: DataFrame) -> DataFrame:
    """Listings of source B's pages (PAGE_B); a page that failed or has no items gives none."""
    return project_b(pages.filter("statusCode = 200").select(F.explode("data.searchData").alias("item")).select("item.*"))


def listings_c(pages: DataFrame, convert: Callable[[Column], Column] = simplified, locations: DataFrame | None = None) -> DataFrame:
    """Listings of source C's pages (PAGE_C) outside of the cities that are not listed.

    With ``locations`` (``locations_c``), only pages asked for one that is crawled count; a page that does not tell its location is none of them.
    """
    good = pages.filter("statusCode = 200")
    if locations is not None:
        good = good.join(crawled(locations).select(F.col("id").alias("locationId")), "locationId", "left_semi")
    items = good.select(F.explode("data").alias("item"), "locationName").select("item.*", "locationName")
    return not_blacklisted(project_c(items, convert))


def cities_b(bodies: DataFrame) -> DataFrame:
    """cityOID, cityName of source B's city lists (CITIES_B)."""
    groups = bodies.filter("statusCode = 200").select(F.explode("result.allCities").alias("g"))
    return groups.select(F.explode("g.cities").alias("c")).select("c.*")


def locations_c(bodies: DataFrame) -> DataFrame:
    """id, code, name of source C's locations (LOCATIONS_C)."""
    return bodies.filter("success").select(F.explode("data").alias("x")).select("x.*")


def crawled(locations: DataFrame) -> DataFrame:
    """Source C's locations but for the mainland, which the other sources have; its parts of other codes stay, and those without one."""
    return locations.filter(~F.col("code").eqNullSafe(MAINLAND))


def city_list(bodies: DataFrame) -> DataFrame:
    """cityId, cityName, url, ord, place of source A's city lists: the hot ones first, then the groups' sites."""
    hot = bodies.select(F.posexplode(F.coalesce("hotCities", "hotCity")).alias("ord", "c"), F.lit("hot").alias("place"))
    groups = bodies.select(F.posexplode(F.flatten(F.transform("groups", lambda g: g["sites"]))).alias("ord", "c"), F.lit("group").alias("place"))
    return hot.unionByName(groups).select("c.cityId", "c.cityName", "c.url", "ord", "place")


def find_city(cities: DataFrame, name: str) -> DataFrame:
    """The first city of that very name of a ``city_list``: of the hot ones, or else of the groups."""
    return cities.filter(F.col("cityName") == name).orderBy(F.col("place") != "hot", "ord").limit(1)
