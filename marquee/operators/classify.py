"""Tributes, official artists, and what an extractor finds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from queue import Empty, Queue
from threading import Thread

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from marquee.functions.text import contains_any, has, or_else, with_artist
from marquee.schema import INVALID_ARTISTS, NOISE_TAGS, TRIBUTE_WORDS


def valid_tag(tag):
    return has(tag) & ~contains_any(tag, NOISE_TAGS)


def is_tribute(title):
    return contains_any(title, TRIBUTE_WORDS)


def official_artist(artist):
    return has(artist) & ~artist.isin("群星", "Unknown") & ~contains_any(artist, TRIBUTE_WORDS)


def route(listings: DataFrame) -> DataFrame:
    """route: tribute (artist Unknown), official (artist goes before the title) or extract (left to the extractor)."""
    title, artist = F.col("title"), F.col("artist")
    routed = listings.withColumn("route", F.when(is_tribute(title), "tribute").when(official_artist(artist), "official").otherwise("extract"))
    tribute, official = F.col("route") == "tribute", F.col("route") == "official"
    return routed.withColumns({"title": F.when(official, with_artist(title, artist)).otherwise(title), "artist": F.when(tribute, "Unknown").otherwise(artist), "is_tribute": tribute | F.coalesce("is_tribute", F.lit(False))})


def extract(listings: DataFrame, extractor: Callable[[list[str]], dict[str, dict]], batch: int = 50, seconds: float = 120) -> DataFrame:
    """title, artist, is_tribute, is_famous of the distinct titles that ``extractor`` knows.

    The extractor gets batches of titles and returns a map from title to a name or to the
    fields; a batch that fails or takes more than ``seconds`` is left out, and its rows stay as they are.
    """

    def within(titles: list[str]) -> dict[str, dict]:
        answer: Queue = Queue()

        def ask() -> None:
            try:
                answer.put(extractor(titles))
            except Exception:  # noqa: BLE001  one batch must not cost the others
                answer.put({})

        Thread(target=ask, daemon=True).start()  # left behind if it hangs
        try:
            return answer.get(timeout=seconds) or {}
        except Empty:
            return {}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            titles = frame["title"].tolist()
            for at in range(0, len(titles), batch):
                found = within(titles[at : at + batch])
                rows = [(t, *((x, False, True) if isinstance(x, str) else (x.get("artist"), x.get("is_tribute"), x.get("is_famous")))) for t, x in found.items() if x]
                yield pd.DataFrame(rows, columns=["title", "artist", "is_tribute", "is_famous"]).astype(object)

    return listings.select("title").distinct().mapInPandas(run, "title string, artist string, is_tribute boolean, is_famous boolean")


def apply_extraction(listings: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with what was found for their exact title; ``found`` has one row for a title."""
    x = found.select(F.col("title").alias("_title"), F.col("artist").alias("_artist"), F.coalesce("is_tribute", F.lit(False)).alias("_tribute"), F.coalesce("is_famous", F.lit(True)).alias("_famous"))
    joined = listings.join(x, F.col("title") == F.col("_title"), "left")
    hit = F.col("_title").isNotNull()
    artist = F.when(F.col("_tribute") | ~F.col("_famous"), "Unknown").otherwise(or_else("_artist", "Unknown"))
    title = F.when(hit & (artist != "Unknown"), with_artist(F.col("title"), artist)).otherwise(F.col("title"))
    return joined.withColumns({"title": title, "artist": F.when(hit, artist).otherwise(F.col("artist")), "is_tribute": F.when(hit, F.col("_tribute")).otherwise(F.col("is_tribute")), "is_famous": F.when(hit, F.col("_famous")).otherwise(F.col("is_famous"))}).drop("_title", "_artist", "_tribute", "_famous")


def fix_invalid_artists(listings: DataFrame) -> DataFrame:
    return listings.withColumn("artist", F.when(F.col("artist").isin(*INVALID_ARTISTS), "Unknown").otherwise(F.col("artist")))
