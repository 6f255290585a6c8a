"""Files that a search opens, counts that follow upserts, pages far down."""

import pytest
from pyspark.sql import functions as F

from marquee.operators import listings as ops, pages, skipping, store
from marquee.schema import LISTING
from tests.test_store import rows

CITIES = ["上海", "北京", "Paris", "ΟΔΟΣΑ", "İzmir"]


def many(spark, n, prefix="i"):
    """Cities and artists in turn; every title has its own number."""
    base = rows(spark, [f"{prefix}{k:04d}" for k in range(n)])
    city = F.element_at(F.array(*map(F.lit, CITIES)), (F.col("ord") % len(CITIES) + 1).cast("int"))
    day = F.format_string("2026.%02d.01", F.col("ord") % 12 + 1)
    return base.withColumns({"city": city, "artist": F.concat(F.lit("artist "), (F.col("ord") % 7).cast("string")), "title": F.concat(F.lit("Show No "), F.lpad("ord", 4, "x")), "date": day})


def table(spark, tmp_path, **options):
    return store.Catalogue(spark, str(tmp_path / "t"), buckets=2, indexed=True, **({"cluster": ("city", "artist"), "file_rows": 20} | options))


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    c = table(spark, tmp_path_factory.mktemp("kept"))
    c.upsert(many(spark, 700))
    return c


WANTED = [
    {"city": "Paris"},
    {"city": "Paris", "artist": "artist 3"},
    {"artist": "nobody"},
    {"words": "NO X123"},
    {"words": "海"},
    {"words": "北京"},
    {"words": "absent words"},
    {"city_part": "ΟΔΟΣ"},
    {"words": "οδος"},
    {"words": "i̇z"},
    {"words": "İ"},
    {"month": "2026-03"},
    {"month": "2026.03", "city": "上海"},
    {"month": "2026-0_", "city": "上海"},
    {"words": "", "city": ""},
]


@pytest.mark.parametrize("wanted", WANTED, ids=map(str, WANTED))
def test_search_finds_what_a_scan_finds(kept, wanted):
    want = kept.read().filter(ops.facet(wanted.get("city"), wanted.get("artist")))
    want = want.filter(ops.search(wanted["words"])) if wanted.get("words") else want
    want = want.filter(ops.city_contains(wanted["city_part"])) if wanted.get("city_part") else want
    want = ops.scan_month(want, wanted["month"]) if wanted.get("month") else want
    assert sorted(r.id for r in kept.search(**wanted).collect()) == sorted(r.id for r in want.collect())


def test_a_search_opens_few_files(kept):
    every = kept.files()
    assert len(every) >= 35
    assert len(kept.files(city="Paris")) <= len(every) / 3
    assert len(kept.files(city="Paris", artist="artist 3")) <= 4
    assert kept.files(artist="nobody") == [] and kept.files(words="absent words") == []
    assert kept.search(artist="nobody").count() == 0
    # One title has it, so of its groups of letters all are in its file and a few others'.
    assert len(kept.files(words="x123")) <= len(every) / 2
    opened = kept.search(city="Paris", artist="artist 3").inputFiles()
    assert sorted(f.split("/t/", 1)[1] for f in opened) == kept.files(city="Paris", artist="artist 3")


def test_months_open_their_files(spark, tmp_path):
    c = table(spark, tmp_path, by_month=True)
    c.upsert(many(spark, 240))
    assert {f.split("month=")[1].split("/")[0] for f in c.files(month="2026.03")} == {"2026-03"}
    assert c.search(month="2026-03").count() == 20
    c = table(spark, tmp_path / "dates", cluster=("date",))
    c.upsert(many(spark, 240))
    assert 0 < len(c.files(month="2026-03")) <= len(c.files()) / 3 and c.search(month="2026-03").count() == 20


def counted(c, column):
    return {r["value"]: r["n"] for r in c.facets(column).collect()}


def recounted(c, column):
    return {r[column]: r["count"] for r in c.read().groupBy(column).count().collect()}


def test_counts_follow_upserts_without_old_rows(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=8, indexed=True)
    assert c.facets("city").count() == 0 and c.search(city="Paris").count() == 0
    c.upsert(many(spark, 200))
    before = c.version()["writes"]
    c.upsert(many(spark, 3).withColumn("city", F.lit("Rome")))
    c.upsert(many(spark, 5, "new"))
    after = c.version()["writes"]
    assert counted(c, "city") == recounted(c, "city") and counted(c, "artist") == recounted(c, "artist") and counted(c, "city")["Rome"] == 3
    assert {r["value"]: r["n"] for r in c.facets("city", "2026-01").collect()} == {r.city: r["count"] for r in ops.scan_month(c.read(), "2026-01").groupBy("city").count().collect()}
    # Rows that no upsert touched can be gone: counts are not made of them.
    (still,) = {w for b, w in after.items() if w == before[b]}
    want = counted(c, "city")
    for f in (tmp_path / "t" / "data" / f"write={still}").rglob("*.parquet"):
        f.unlink()
    assert counted(c, "city") == want


def test_index_goes_with_its_rows(spark, tmp_path):
    c = table(spark, tmp_path)
    for k in range(3):
        c.upsert(many(spark, 30).withColumn("city", F.lit(f"city {k}")))
    c.vacuum()
    for part in store.PARTS:
        assert len(list((tmp_path / "t" / part).glob("write=*"))) == 1
    assert c.search(city="city 2").count() == 30 and c.files(city="city 1") == [] and counted(c, "city") == {"city 2": 30}
    c.replace(many(spark, 5))
    assert c.search(city="Paris").count() == 1


def test_tables_without_index_are_read_whole(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"))
    c.upsert(many(spark, 10))
    assert c.search(city="Paris").count() == 2
    again = store.Catalogue(spark, str(tmp_path / "t"), indexed=True)
    again.upsert(many(spark, 5, "n"))
    assert again.search(city="Paris").count() == 3
    with pytest.raises(ValueError):
        again.facets("city")


def test_nulls_ties_and_long_texts(spark, tmp_path):
    c = table(spark, tmp_path, file_rows=0)
    odd = [("a", None, None, None, None), ("b", "", "", "", ""), ("c", "x" * 50_000 + "needle", "v", "2026.01.01", "上海"), ("c", "t", "v", "2026.01.01", "上海")]
    frame = spark.createDataFrame([(i, t, "", d, s, v, "", "", "", None, None, None, None, k) for k, (i, t, v, d, s) in enumerate(odd)], f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in LISTING)}, ord long")
    c.upsert(frame)
    assert {r.id for r in c.search(city="上海").collect()} == {"c"} and counted(c, "city") == {"": 2, "上海": 1}
    c.upsert(frame.filter("ord = 2"))
    assert c.search(words="needle").count() == 1 and c.search(month="2026-01").count() == 1


def test_bits_of_values(spark):
    seen = spark.createDataFrame([("w", 0, "", "f", None, None, None, None, None)], "write string, bucket int, month string, file string, title string, venue string, city string, artist string, date string")
    (row,) = skipping.summarise(seen).collect()
    assert row.n == 1 and row.city is None and row.least is None
    assert skipping.summarise(seen).filter(skipping.may_have(city="x")).count() == 0
    assert skipping.summarise(seen).filter(skipping.may_have()).count() == 1


def test_deep_pages_are_those_of_the_whole_order(spark, tmp_path):
    # A third of the rows has one date.
    frame = many(spark, 500).withColumn("date", F.when(F.col("ord") % 3 == 0, "2026.05.05").when(F.col("ord") % 50 == 1, None).when(F.col("ord") % 50 == 2, "").otherwise(F.col("date")))
    ranked = pages.Ranked(spark, str(tmp_path / "r"), range_rows=40).build(frame)
    whole = [r.id for r in ops.in_order(frame).collect()]
    assert ranked.total() == 500
    for number, size in ((1, 20), (2, 45), (13, 20), (25, 20), (26, 20), (7, 77), (1, 600), (100_000, 20)):
        got = ranked.page(number, size)
        assert [r.id for r in got.collect()] == whole[(number - 1) * size : number * size], (number, size)
        assert got.columns == frame.columns
    deep = ranked.page(20, 10)
    plan = deep._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" not in plan and "PartitionFilters: [" in plan
    with pytest.raises(ValueError):
        ranked.page(0)


def test_a_day_with_many_rows_is_several_ranges(spark, tmp_path):
    ranked = pages.Ranked(spark, str(tmp_path / "r"), range_rows=50).build(many(spark, 400).withColumn("date", F.lit("2026.05.05")))
    sizes = [r.n for r in spark.read.parquet(str(tmp_path / "r" / "directory")).collect()]
    assert len(sizes) >= 6 and max(sizes) <= 120
    assert [r.id for r in ranked.page(40, 10).collect()] == [f"i{k:04d}" for k in range(390, 400)]


def test_pages_of_nothing(spark, tmp_path):
    ranked = pages.Ranked(spark, str(tmp_path / "r")).build(many(spark, 1).limit(0))
    assert ranked.total() == 0 and ranked.page(1).count() == 0 and ranked.page(3).columns == many(spark, 1).columns


def test_pages_after_a_row_walk_through_all(spark):
    frame = many(spark, 90).withColumn("date", F.when(F.col("ord") % 7 == 1, None).when(F.col("ord") % 7 == 2, "").otherwise("2026.05.05 20:00")).cache()
    whole = [r.id for r in ops.in_order(frame).collect()]
    got = [r for r in ops.page(frame, 1, 25).collect()]
    while more := pages.page_after(frame, got[-1].date, got[-1].id, 25).collect():
        got += more
    assert [r.id for r in got] == whole
    assert "TakeOrderedAndProject" in pages.page_after(frame, None, "x", 5)._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        pages.page_after(frame, "", "x", 0)


def test_a_text_is_cut_once_for_a_file(spark):
    from marquee.operators import skipping

    rows = spark.range(100).selectExpr("'w' AS write", "1 AS bucket", "'' AS month", "'f' AS file", "'2026.05.01' AS date", "'Some Show' AS title", "'Hall' AS venue", "'A' AS city", "'Hall' AS artist")
    made = skipping.summarise(rows)
    assert made.count() == 1
    plan = made._jdf.queryExecution().analyzed().toString()
    assert any("Aggregate [write" in line and ", text#" in line.split("]")[0] for line in plan.splitlines())
