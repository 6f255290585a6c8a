"""Paging rules page by page, and runs that hang in a stream."""

import datetime as dt


from marquee.sources import paging
from marquee.streaming.transitions import transition_stream

PAGES = "city string, page int, ok boolean, ids array<string>, cancelled boolean, total long"


def test_where_a_city_ends(spark):
    full = lambda *x: list(x)
    cities = {
        "two empty": [(True, []), (False, None), (True, []), (True, full("x", "y"))],
        "an empty one": [(True, full("a", "b")), (True, []), (True, full("c", "d")), (True, full("e"))],
        "nothing new": [(True, full("a", "b")), (True, full("b", "a")), (True, full("c", "d"))],
        "short": [(True, full("a", "a")), (True, full("b")), (True, full("c", "d"))],
        "three failures": [(True, full("a", "b")), (False, None), (None, full("z", "y")), (False, None), (True, full("c", "d"))],
        "two failures": [(False, None), (False, None), (True, full("c", "d"))],
    }
    rows = [(c, k, ok, ids, None, 0) for c, pages in cities.items() for k, (ok, ids) in enumerate(pages, 1)]
    rows += [("gap", 1, True, ["a", "b"], False, 0), ("gap", 3, True, ["c", "d"], False, 0)]
    rows += [("cancelled", 1, True, ["a", "b"], False, 0), ("cancelled", 2, True, ["c", "d"], True, 0)]
    rows += [("over before", 1, True, ["a"], False, 0), ("over before", 2, True, ["c", "d"], True, 0)]
    got: dict = {}
    for r in paging.pages_a(spark.createDataFrame(rows, PAGES), size=2).collect():
        got.setdefault(r.city, set()).add(r.id)
    assert got == {"an empty one": set("abcde"), "nothing new": set("ab"), "short": set("ab"), "three failures": set("ab"), "two failures": set("cd"), "gap": set("ab"), "over before": set("a")}


def test_pages_with_totals(spark):
    rows = [("a", k, True, [f"{k}"], None, 25) for k in range(1, 6)] + [("b", 1, True, ["1"], None, 99), ("b", 2, False, ["2"], None, 99), ("b", 3, True, ["3"], None, 99), ("c", 1, True, ["1"], None, None)]
    rows += [("d", k, True, ["x"], None, 10**6) for k in range(1, 30)]
    got = [(r.city, r.page) for r in paging.pages_total(spark.createDataFrame(rows, PAGES)).collect()]
    assert sorted(got) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("c", 1), *[("d", k) for k in range(1, 21)]]


def test_a_run_that_hangs_goes_to_error(spark, tmp_path):
    at = lambda minute: dt.datetime(2026, 1, 1, 0, minute, tzinfo=dt.UTC)
    files = [[("a", 1, at(0), "idle"), ("a", 2, at(1), "running"), ("b", 3, at(1), "running")], [("b", 4, at(3), "completed")], [("c", 5, at(30), "idle")], [("c", 6, at(31), "idle")]]
    for rows in files:
        spark.createDataFrame(rows, "id string, seq long, at timestamp, status string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("id string, seq long, at timestamp, status string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = transition_stream(source, "id", stuck_ms=300_000).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "p")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.id, r.seq or 0, r.before, r.status) for r in spark.read.parquet(str(tmp_path / "out")).select("id", "seq", "before", "status").collect())
    assert got == [("a", 0, "running", "error"), ("a", 2, "idle", "running"), ("b", 4, "running", "completed")]


def test_uploads_land_in_many_files_and_are_a_batch_each(spark, tmp_path):
    from pyspark.sql import functions as F

    from marquee.plans import catalogue

    rows = spark.range(1000).repartition(3).select(F.col("id").alias("ord"), F.lit(1).alias("updated_at"))
    seen = []
    catalogue._by_uploads(rows, str(tmp_path / "in"), 4, lambda: seen.append((len(list((tmp_path / "in").glob("*.json"))), spark.read.json(str(tmp_path / "in")).count())))
    assert [n for _, n in seen] == [250, 500, 750, 1000] and seen[0][0] == 3
