"""Writing the catalogue: defaults, keep-last, upsert, replace, versions."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from marquee.folders import checkpointed, create, delete_folder, names, read_text
from marquee.functions.text import has, or_else
from marquee.operators import skipping
from marquee.operators.listings import city_contains, facet, scan_month, search
from marquee.schema import LISTING

#: Columns whose values an indexed table counts.
FACETS = ("city", "artist")
#: Folders of a table that have a part for each write.
PARTS = ("data", "index/files", "index/facets")
_TEXTS = {"image": "", "city": "", "venue": "", "price": "", "status": "Unknown", "category": "Concert", "artist": ""}


def with_defaults(listings: DataFrame, now_ms: int = 0) -> DataFrame:
    """Null and empty values become the stored defaults; false stays false."""
    return listings.withColumns(
        {c: or_else(c, v) for c, v in _TEXTS.items()}
        | {"is_tribute": F.coalesce("is_tribute", F.lit(False)), "is_famous": F.coalesce("is_famous", F.lit(True)), "updated_at": F.coalesce(F.nullif("updated_at", F.lit(0).cast("long")), F.lit(now_ms).cast("long"))}
    )


def _one(listings: DataFrame, keys: list[str], best) -> DataFrame:
    others = [c for c in listings.columns if c not in keys]
    return listings.groupBy(*keys).agg(best(F.struct(*others)).alias("kept")).select(*keys, "kept.*").select(*listings.columns)


def keep_last(listings: DataFrame, keys: list[str], ord_column: str = "ord") -> DataFrame:
    """The last row of each key: an aggregate with map-side combination, so a hot key is no hot task."""
    return _one(listings, keys, lambda row: F.max_by(row, ord_column))


def keep_first(listings: DataFrame, keys: list[str], ord_column: str = "ord") -> DataFrame:
    return _one(listings, keys, lambda row: F.min_by(row, ord_column))


def upsert(existing: DataFrame, incoming: DataFrame, ord_column: str = "ord") -> DataFrame:
    """Existing rows but for incoming ids, and the last incoming row of each id with defaults."""
    new = with_defaults(keep_last(incoming, ["id"], ord_column))
    return existing.join(new.select("id"), "id", "left_anti").unionByName(new.select(*existing.columns))


def valid_upload(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with id, title and date, and the others for quarantine."""
    good = has("id") & has("title") & has("date")
    return rows.filter(good), rows.filter(~good)


def _month() -> Column:
    """The month that a date text starts with, or none."""
    year, month = (F.regexp_extract("date", "^([0-9]{4})[-.]([0-9]{2})", k) for k in (1, 2))
    return F.when(year != "", F.concat_ws("-", year, month)).otherwise("none")


class Conflict(RuntimeError):
    """Other writers came first as often as a change was tried."""


class Catalogue:
    """Versions of the stored table in a folder.

    Rows lie in buckets by their ids.  A version is a small file that names for each bucket the write that it is of, so
    an upsert reads and writes the buckets of its ids alone; ``buckets`` is fixed by the first version
    and should make a bucket a file or a few.  Version files are created only where none
    is, so of two writers of one version the second finds out: it goes on from the newer version, and
    starts again if that has other rows in what it read.  Readers see a whole version.  A version also carries
    the last batch of each stream, so a batch that runs again changes nothing.

    An ``indexed`` table has beside each write what its files may hold (``operators/skipping.py``) and how often
    each city and artist is in each of its buckets and months.  ``search`` opens only files that can have a hit, and ``facets``
    adds up counts without opening any.  A write never changes, so neither does what is known of it: an upsert counts the
    buckets that it writes and no others.
    """

    def __init__(self, spark: SparkSession, folder: str, by_month: bool = False, buckets: int = 16, tries: int = 20, indexed: bool = False, cluster: tuple[str, ...] = (), file_rows: int = 0):
        """``by_month`` lays the rows of a bucket out by the month that their date text starts with, so that ``read_month`` reads that one alone.

        ``indexed`` is fixed by the first version, as ``buckets`` is.  ``cluster`` names columns that the rows of a bucket (and month) are
        in the order of, and ``file_rows`` how many a file has at most (0: all of them), so that files differ in what they hold.
        """
        self.spark, self.folder, self.by_month, self.buckets, self.tries = spark, folder, by_month, buckets, tries
        self.indexed, self.cluster, self.file_rows = indexed, cluster, file_rows

    def version(self) -> dict:
        """The newest version: number, buckets, indexed, writes (bucket: write), streams (name: last batch)."""
        found = names(self.spark, f"{self.folder}/versions")
        if strange := [f for f in found if not re.fullmatch(r"[0-9]{20}[.]json|[.].*", f)]:
            raise ValueError(f"no version: {strange[0]}")
        numbers = [f for f in found if not f.startswith(".")]
        if not numbers:
            return {"number": 0, "buckets": self.buckets, "indexed": self.indexed, "writes": {}, "streams": {}}
        return json.loads(read_text(self.spark, f"{self.folder}/versions/{numbers[-1]}"))

    def read(self, version: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets."""
        return self._rows(version or self.version(), buckets).select(*LISTING.names)

    def _rows(self, version: dict, buckets: list[int] | None = None, placed: bool = False) -> DataFrame:
        held = version["writes"].items() if buckets is None else [(str(b), version["writes"][str(b)]) for b in buckets if str(b) in version["writes"]]
        return self._read([f"{self.folder}/data/write={w}/bucket={b}" for b, w in held], placed)

    def _read(self, paths: list[str], placed: bool = False) -> DataFrame:
        """Rows of folders or files of the table; ``placed`` adds the file's name, and a month of "" where files are not by month."""
        layout = [T.StructField("write", T.StringType()), T.StructField("bucket", T.IntegerType()), *([T.StructField("month", T.StringType())] if self.by_month else [])]
        schema = T.StructType([*LISTING.fields, *layout])
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.folder}/data").parquet(*paths)
        if placed:
            rows = rows.withColumn("file", F.col("_metadata.file_name"))
            rows = rows if self.by_month else rows.withColumn("month", F.lit(""))
        return rows

    def read_month(self, month: str) -> DataFrame:
        """Listings whose date text starts with ``yyyy-MM`` or ``yyyy.MM``."""
        rows = self._rows(self.version())
        return scan_month(rows.filter(F.col("month") == month) if self.by_month else rows, month).select(*LISTING.names)

    def find(self, ids: list[str]) -> DataFrame:
        """Rows with some ids: only their buckets are read."""
        version = self.version()
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        own = [r[0] for r in wanted.select(self._bucket(version["buckets"])).distinct().collect()]
        return self.read(version, own).filter(F.col("id").isin(ids))

    @staticmethod
    def _bucket(buckets: int):
        return F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int").alias("bucket")

    def _write(self, rows: DataFrame, base: dict) -> dict:
        """Rows as a new write: its name by bucket."""
        write = uuid.uuid4().hex
        buckets = base["buckets"]
        rows = rows.select(*LISTING.names).withColumn("bucket", self._bucket(buckets))
        layout = ["bucket"]
        if self.by_month:
            rows, layout = rows.withColumn("month", _month()), ["bucket", "month"]
        folder = f"{self.folder}/data/write={write}"
        dealt = rows.repartition(buckets, "bucket")
        if self.cluster:
            dealt = dealt.sortWithinPartitions(*layout, *self.cluster)
        dealt.write.option("maxRecordsPerFile", self.file_rows).partitionBy(*layout).parquet(folder)
        own = {n.removeprefix("bucket="): write for n in names(self.spark, folder) if n.startswith("bucket=")}
        if own and base.get("indexed"):
            self._describe(own)
        return own

    def _describe(self, own: dict) -> None:
        """Writes down what the files of a new write hold, and its counts."""
        (write,) = set(own.values())
        rows = self._rows({"writes": own}, placed=True)
        skipping.summarise(rows).drop("write").write.parquet(f"{self.folder}/index/files/write={write}")
        values = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in FACETS)))
        seen = rows.select("bucket", _month().alias("month"), values.alias("x")).groupBy("bucket", "month", "x.facet", "x.value")
        seen.agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{self.folder}/index/facets/write={write}")

    def _described(self, version: dict, what: str) -> DataFrame:
        """What is written down of the buckets that a version has."""
        if not version.get("indexed"):
            raise ValueError("the table is not indexed")
        live = self.spark.createDataFrame([(w, int(b)) for b, w in version["writes"].items()], "write string, bucket int")
        base = f"{self.folder}/index/{what}"
        schema = {"files": skipping.SUMMARY, "facets": "bucket int, month string, facet string, value string, n long"}[what]
        noted = self.spark.read.schema(f"{schema}, write string").option("basePath", base).parquet(*(f"{base}/write={w}" for w in sorted(set(version["writes"].values()))))
        return noted.join(live, ["write", "bucket"], "left_semi")

    def files(self, month: str | None = None, **wanted: str | None) -> list[str]:
        """Files of the newest version that can have rows as ``search`` takes them: below the table's folder, in order.

        Their names come to the driver, where Spark plans its scans of them, as it does with all names of a folder.
        """
        return self._files(self.version(), month, wanted)

    def _files(self, version: dict, month: str | None, wanted: dict) -> list[str]:
        if not version["writes"]:
            return []
        found = self._described(version, "files").filter(skipping.may_have(month=month, **wanted))
        if self.by_month and month and re.fullmatch("[0-9]{4}[-.][0-9]{2}", month):
            found = found.filter(F.col("month") == month.replace(".", "-"))
        place = [F.lit("data/write="), "write", F.lit("/bucket="), "bucket", *([F.lit("/month="), "month"] if self.by_month else []), F.lit("/"), "file"]
        return sorted(r[0] for r in found.select(F.concat(*place)).collect())

    def search(self, city: str | None = None, artist: str | None = None, words: str | None = None, month: str | None = None, city_part: str | None = None) -> DataFrame:
        """Rows of this very city and artist, with words in any text, whatever their case, of a month, with part of a city's name.

        What is None or empty does not matter.  Only files that can have a hit are read; a table that
        is not indexed is read whole.
        """
        version, wanted = self.version(), {"city": city, "artist": artist, "words": words, "city_part": city_part}
        if version.get("indexed"):
            paths = [f"{self.folder}/{f}" for f in self._files(version, month, wanted)]
            rows = self._read(paths)
        else:
            rows = self._rows(version)
        rows = rows.filter(facet(city, artist))
        for given, hit in ((words, search), (city_part, city_contains)):
            rows = rows.filter(hit(given)) if given else rows
        return (scan_month(rows, month) if month else rows).select(*LISTING.names)

    def facets(self, column: str, month: str | None = None) -> DataFrame:
        """value, n of each city or artist, of all rows or those of a month ``yyyy-MM``: added up from counts by bucket, no row is read."""
        if column not in FACETS:
            raise ValueError(f"counted are {', '.join(FACETS)}")
        version = self.version()
        if not version["writes"]:
            return self.spark.createDataFrame([], "value string, n long")
        noted = self._described(version, "facets").filter(F.col("facet") == column)
        if month:
            noted = noted.filter(F.col("month") == month.replace(".", "-", 1))
        return noted.groupBy("value").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "value")

    def _publish(self, base: dict, writes: dict, streams: dict) -> bool:
        made = {"number": base["number"] + 1, "buckets": base["buckets"], "indexed": base.get("indexed", False), "writes": writes, "streams": base["streams"] | streams}
        return create(self.spark, f"{self.folder}/versions/{made['number']:020d}.json", json.dumps(made))

    def replace(self, listings: DataFrame) -> None:
        """A version of these rows alone; whoever replaces last wins."""
        writes = self._write(listings, self.version())
        for _ in range(self.tries):
            if self._publish(self.version(), writes, {}):
                return
        raise Conflict(f"{self.tries} tries")

    def upsert(self, incoming: DataFrame, ord_column: str = "ord", batch: tuple[str, int] | None = None) -> None:
        """Keep-last upsert.  With ``batch`` (name of a stream, number) it is done once, however often it is asked for."""
        self.change(lambda _: incoming, ord_column, batch, blind=True)

    def change(self, make: Callable[[DataFrame], DataFrame], ord_column: str = "ord", batch: tuple[str, int] | None = None, blind: bool = False) -> None:
        """Upserts what ``make`` makes of the stored rows.

        If another writer publishes meanwhile, it is made again of the newer rows; not so if it is ``blind`` to
        them and the other writer has touched other buckets.
        """
        for _ in range(self.tries):
            base = self.version()
            if batch and base["streams"].get(batch[0], -1) >= batch[1]:
                return
            streams = {batch[0]: batch[1]} if batch else {}
            new = with_defaults(keep_last(make(self.read(base)), ["id"], ord_column))
            # Read twice, for its buckets and its rows, so it is cut from what made it.
            new = checkpointed(new.select(*LISTING.names))
            own = sorted(r[0] for r in new.select(self._bucket(base["buckets"])).distinct().collect())
            kept = self.read(base, own).join(new.select("id"), "id", "left_anti")
            writes = self._write(kept.unionByName(new), base) if own else {}
            last = base
            while not self._publish(last, last["writes"] | writes, streams):
                last = self.version()
                touched = not blind or any(last["writes"].get(str(b)) != base["writes"].get(str(b)) for b in own)
                if touched or batch and last["streams"].get(batch[0], -1) >= batch[1]:
                    for w in set(writes.values()):
                        for part in PARTS:
                            delete_folder(self.spark, f"{self.folder}/{part}/write={w}")
                    break
            else:
                return
        raise Conflict(f"{self.tries} tries")

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all but the last versions, and the writes that none of those names; not while others write or read older ones."""
        files = [f for f in names(self.spark, f"{self.folder}/versions") if not f.startswith(".")]
        for f in files[:-keep]:
            delete_folder(self.spark, f"{self.folder}/versions/{f}")
        named = {w for f in files[-keep:] for w in json.loads(read_text(self.spark, f"{self.folder}/versions/{f}"))["writes"].values()}
        for part in PARTS:
            for n in names(self.spark, f"{self.folder}/{part}"):
                if n.removeprefix("write=") not in named:
                    delete_folder(self.spark, f"{self.folder}/{part}/{n}")
