"""Hand cases of text, dates, store, sources, classification, control and streaming."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from marquee.functions import text
from marquee.operators import calendar, classify, control, listings as ops, store
from marquee.schema import CITIES_A, CITIES_B, LISTING, LOCATIONS_C, PAGE_C
from marquee.sources import landing, status
from marquee.streaming import uploads as uploads_


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("title", "plain"),
    [("【A】A Live Tour 2026 上海站", "a上海"), ("[X] (Y) B Concert", "b"), ("C（D）演唱会", "c（d）"), ("LIVE 2026", ""), ("20260 E", "0e"), ("a　b c", "abc")],
)
def test_normalize_title(spark, title, plain):
    from marquee.operators.merge import plain_title

    assert one(spark, title, text.normalize_title) == plain == plain_title(title)


@pytest.mark.parametrize(
    ("date", "start", "fallback"),
    [
        ("2026.03.28 周六 19:00", "2026-03-28 19:00", False),
        (" 2026.03.29 周日 19:00", "2026-03-29 19:00", False),
        ("时间：2026.03.30", "2026-03-30 19:30", False),
        ("2026/3/5", "2026-03-05 19:30", False),
        ("2026.01.30-02.01", "2026-01-30 19:30", False),
        ("2026-06-13~2026-06-14 雙日票", "2026-06-13 19:30", False),
        ("2026.13.40", "2027-02-09 19:30", False),
        ("2026.03.28 25:61", "2026-03-29 02:01", False),
        ("2026年5月9日", "2026-01-01 19:30", True),
        ("时间待定", "2026-01-01 19:30", True),
    ],
)
def test_event_dates(spark, date, start, fallback):
    row = spark.createDataFrame([("1", "t", None, date, *[None] * 9)], LISTING)
    e = calendar.events(row, "2026-01-01").first()
    assert (e.start.strftime("%Y-%m-%d %H:%M"), e.is_fallback, e.end - e.start) == (start, fallback, dt.timedelta(hours=3))


def test_sort_and_pages(spark):
    rows = spark.createDataFrame([("a", " 2026.01.01"), ("b", "2026.02.01 周日"), ("c", "2026-01-15"), ("d", "时间待定")], "id string, date string")
    assert [r.id for r in ops.in_order(rows).collect()] == ["c", "b", "a", "d"]
    assert [r.id for r in ops.page(rows, 2, 3).collect()] == ["d"] and ops.page(rows, 3, 3).count() == 0
    assert ops.envelope(rows, 1, 3).first().total_pages == 2
    with pytest.raises(ValueError):
        ops.page(rows, 0)


def test_month_wildcards_are_not_escaped(spark):
    rows = spark.createDataFrame([("2026-03-01",), ("2026.03.02",), (" 2026.03.03",), ("2026/03/04",)], "date string")
    assert ops.scan_month(rows, "2026-03").count() == 2 and ops.scan_month(rows, "20__-03").count() == 2


def test_search_and_city_filters_differ(spark):
    rows = spark.createDataFrame([("x", "v", "上海", "a"), ("x", None, None, None)], "title string, venue string, city string, artist string")
    assert rows.filter(ops.search("上海")).count() == 1
    assert rows.filter(ops.facet(words="上海")).count() == 0
    assert rows.filter(ops.city_contains("上")).count() == 1 and rows.filter(ops.facet(city="上")).count() == 0


def test_keep_last_and_upsert(spark):
    make = lambda rows: spark.createDataFrame([(i, t, None, "d", "", "", "", s, "", "", None, f, None, k) for k, (i, t, s, f) in enumerate(rows)], _with_ord())
    new = make([("1", "a", "", None), ("2", "b", "On", False), ("1", "c", "", None)])
    old = make([("1", "z", "Off", None), ("3", "y", "Off", None)]).drop("ord")
    got = {r.id: (r.title, r.status, r.is_famous, r.category) for r in store.upsert(old, new).collect()}
    assert got == {"1": ("c", "Unknown", True, "Concert"), "2": ("b", "On", False, "Concert"), "3": ("y", "Off", None, "")}


def _with_ord():
    from pyspark.sql import types as T

    return T.StructType([*LISTING.fields, T.StructField("ord", T.LongType())])


def test_versions(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path))
    assert c.read().count() == 0
    row = lambda i, t, k: (i, t, "", "d", "", "", "", "", "", "", False, True, 1, k)
    c.upsert(spark.createDataFrame([row("1", "a", 0)], _with_ord()))
    c.upsert(spark.createDataFrame([row("1", "b", 0), row("2", "c", 1)], _with_ord()))
    assert {(r.id, r.title) for r in c.read().collect()} == {("1", "b"), ("2", "c")}
    c.replace(spark.createDataFrame([row("9", "n", 0)], _with_ord()))
    assert [r.id for r in c.read().collect()] == ["9"]


def test_uploads_need_three_fields(spark):
    good, bad = store.valid_upload(spark.createDataFrame([("1", "t", "d"), ("", "t", "d"), ("2", None, "d")], "id string, title string, date string"))
    assert (good.count(), bad.count()) == (1, 2)


def test_tree_walk_gives_nodes_before_their_children(spark):
    leaf = lambda i, **k: {"type": "7587", "data": {"id": i, **k}}
    tree = {"nodes": [{"type": "g", "nodes": [leaf("1") | {"nodes": [leaf("1a")]}, {"type": "g", "nodes": [leaf("2")]}]}, leaf("3"), {"type": "7587", "data": {"name": "no id"}}]}
    trees = spark.createDataFrame([(0, json.dumps(tree)), (1, "{}"), (2, '{"nodes":[]}')], "tree_id int, body string")
    nodes = landing.listing_nodes(landing.flatten_tree(trees)).orderBy("tree_id", "path")
    assert [r[0] for r in nodes.select(F.try_variant_get("data", "$.id", "string")).collect()] == ["1", "1a", "2", "3"]


def test_source_a_fields(spark):
    data = {"itemId": "7", "showTag": "热销榜", "cityName": "　上海 ", "priceLow": "80", "showStatus": {"desc": "On"}}
    trees = spark.createDataFrame([(0, json.dumps({"nodes": [{"type": "7587", "data": data}, {"type": "7587", "data": {"id": "8", "name": "n", "showTag": ""}}]}))], "tree_id int, body string")
    a, b = landing.project_a(landing.listing_nodes(landing.flatten_tree(trees)).orderBy("path")).collect()
    assert (a.id, a.title, a.city, a.price, a.status, a.artist, a.is_famous) == ("7", "热销榜", "上海", "80", "On", "", False)
    assert (b.title, b.price, b.category, b.is_famous) == ("n", "Pending", "Concert", True)


def test_nested_trees(spark):
    tree = {"nodes": [{"type": "g", "nodes": [{"type": "h", "nodes": [{"type": "7587", "data": {"id": "5", "name": "a word"}}]}]}]}
    trees = spark.createDataFrame([(0, json.dumps(tree)), (1, "no json"), (2, None)], "tree_id int, body string")
    nodes = landing.flatten_tree(trees)
    assert [(r.path, r.type) for r in nodes.orderBy("path").collect()] == [([0], "g"), ([0, 0], "h"), ([0, 0, 0], "7587")]
    assert sorted((r.type, r.is_listing) for r in landing.find_keyword(nodes, "word").collect()) == [("7587", True), ("g", False), ("h", False)]
    assert landing.find_keyword(nodes, "7587").filter("is_listing").count() == 0
    assert landing.flatten_tree(trees, depth=3).count() == 3
    with pytest.raises(Exception, match="deeper than 2"):
        landing.flatten_tree(trees, depth=2).collect()


def test_trees_are_read_once_whatever_their_depth(spark, tmp_path):
    deep = {"type": "7587", "data": {"id": "5"}}
    for _ in range(60):
        deep = {"type": "g", "nodes": [deep, {"type": "g", "nodes": None}]}
    spark.createDataFrame([(0, json.dumps({"nodes": [deep]})), (0, json.dumps({"nodes": [deep]}))], "tree_id int, body string").write.parquet(str(tmp_path / "trees"))
    context = spark.sparkContext
    trees = spark.read.parquet(str(tmp_path / "trees"))
    context.setJobGroup("planning of trees", "")
    nodes = landing.flatten_tree(trees)
    assert not context.statusTracker().getJobIdsForGroup("planning of trees")
    context.setJobGroup("later", "")
    assert nodes._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert nodes.count() == 2 * 121
    assert landing.listing_nodes(nodes).select(F.size("path")).first()[0] == 61


@pytest.mark.parametrize(
    "text, want",
    [("頭髮後", "头发后"), ("皇后後", "皇后后"), ("髮發", "髮发"), ("a|b", "a&b"), ("a", "a"), ("", ""), (None, None), ("發財發", "发财发"), ("臺灣", "台湾"), ("ab" * 3, "ababab"), ("x" * 100_000 + "頭髮", "x" * 100_000 + "头发")],
)
def test_the_longest_phrase_beats_its_characters(spark, text, want):
    words = [("頭髮", "头发"), ("頭", "头"), ("後", "后"), ("皇后", "皇后"), ("發", "发"), ("發財", "发财"), ("a|b", "a&b"), ("", "no"), (None, "no"), ("臺", None), ("頭髮", "头髮?")]
    convert = landing.phrases(spark.createDataFrame(words, "phrase string, simplified string"))
    assert spark.createDataFrame([(text,)], "t string").select(convert(F.col("t"))).first()[0] == want


def test_phrases_have_a_limit_and_may_be_none(spark):
    words = spark.createDataFrame([("a", "b"), ("c", "d")], "phrase string, simplified string")
    with pytest.raises(ValueError):
        landing.phrases(words, limit=1)
    same = landing.phrases(words.limit(0), characters={})
    assert spark.createDataFrame([("ac",)], "t string").select(same(F.col("t"))).first()[0] == "ac"


def test_pages_of_the_mainland_are_left_out(spark):
    places = spark.createDataFrame([("1", "CN", "China"), ("2", "HK", "Hong Kong"), ("3", None, "Macau")], "id string, code string, name string")
    assert sorted(r.id for r in landing.crawled(places).collect()) == ["2", "3"]
    item = [{"id": "7", "title": "t", "location": "x", "showDate": "2026/01/01"}]
    pages = [json.dumps({"statusCode": 200, "locationId": k, "data": [item[0] | {"id": f"{k}"}]}) for k in ("1", "2", "3", None, "9")]
    frame = spark.createDataFrame([(p,) for p in pages], "value string").select(F.from_json("value", PAGE_C).alias("p")).select("p.*")
    assert sorted(r.id for r in landing.listings_c(frame, locations=places).collect()) == ["mtglobal_2", "mtglobal_3"]
    assert landing.listings_c(frame).count() == 5


def test_city_lookup(spark):
    city = lambda i, name: {"cityId": i, "cityName": name, "url": ""}
    body = {"hotCity": [city("1", "A")], "groups": [{"sites": [city("2", "A"), city("3", "B")]}, {"sites": [city("4", "B")]}]}
    cities = landing.city_list(spark.createDataFrame([(json.dumps(body),)], "b string").select(F.from_json("b", CITIES_A).alias("x")).select("x.*"))
    assert [[r.cityId for r in landing.find_city(cities, name).collect()] for name in "ABC"] == [["1"], ["3"], []]


def test_landed_pages(spark, tmp_path):
    page = {"statusCode": 200, "locationName": "臺灣", "data": [{"id": "1", "title": "廣場 X", "showDate": "2026/03/13", "status": "ONSALE"}, {"id": "2", "location": "巴黎"}]}
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "1.json").write_text(json.dumps(page, indent=1), encoding="utf-8")
    (tmp_path / "c" / "2.json").write_text(json.dumps({"statusCode": 500}), encoding="utf-8")
    (got,) = landing.listings_c(landing.read_pages(spark, PAGE_C, str(tmp_path / "c"))).collect()
    assert (got.id, got.title, got.city, got.date, got.status, got.price) == ("mtglobal_1", "广场 X", "台湾", "2026.03.13", "销售中", "Pending")
    bodies = spark.createDataFrame([(json.dumps({"statusCode": 200, "result": {"allCities": [{"title": "A", "cities": [{"cityOID": "7", "cityName": "x"}]}, {"title": "B"}]}}),)], "b string")
    assert [tuple(r) for r in landing.cities_b(bodies.select(F.from_json("b", CITIES_B).alias("x")).select("x.*")).collect()] == [("7", "x")]
    bodies = spark.createDataFrame([(json.dumps({"success": True, "data": [{"id": "1", "code": "HK", "name": "n"}]}),), ('{"success": false}',)], "b string")
    assert [tuple(r) for r in landing.locations_c(bodies.select(F.from_json("b", LOCATIONS_C).alias("x")).select("x.*")).collect()] == [("1", "HK", "n")]


def test_a_corpus_of_json_arrays(spark, tmp_path):
    rows = [{"id": f"i{k % 12}", "title": f"T{k} live" if k % 3 else "致敬 T", "date": f"2026.{1 + k % 3:02}.05" if k % 5 else "时间待定", "city": "上海" if k % 2 else "广州", "venue": "v", "updatedAt": k} for k in range(20)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.json").write_text(json.dumps([r for k, r in enumerate(rows) if (k < 10) == (name == "a")], indent=1), encoding="utf-8")
    found = landing.read_listings(spark, str(tmp_path / "*.json"))
    assert found.columns == LISTING.names and found.count() == 20
    last = store.keep_last(found.withColumn("ord", F.col("updated_at")), ["id"])
    assert last.count() == 12 and last.agg(F.min("updated_at")).first()[0] == 8
    assert {m: ops.scan_month(found, f"2026-{m:02}").count() for m in (1, 2, 3, 4)} == {m: sum(r["date"].startswith(f"2026.{m:02}") for r in rows) for m in (1, 2, 3, 4)}
    assert [tuple(r)[:2] for r in ops.counts(found.withColumn("ord", F.col("updated_at")), "city").collect()] == [("广州", 10), ("上海", 10)]
    assert found.filter(classify.is_tribute(F.col("title"))).count() == sum("致敬" in r["title"] for r in rows)


def test_status_documents(spark, tmp_path):
    folder = str(tmp_path / "status")
    assert tuple(status.read_status(spark, folder, 5).first()) == ("idle", 0, 0, 0, "", 5, None)
    schema = "status string, result struct<success boolean, totalNew int, totalCombined int, message string, timedOutSources array<string>, failedSources array<string>>"
    status.update_status(spark, folder, spark.createDataFrame([("completed", (True, 6, 9, None, ["A"], None))], schema), 10)
    status.update_status(spark, folder, spark.createDataFrame([(30,)], "progress int"), 20)
    row = status.read_status(spark, folder, 99).first()
    assert (row.status, row.progress, row.lastUpdated, row.result.totalNew, row.result.timedOutSources) == ("completed", 30, 20, 6, ["A"])
    status.update_status(spark, folder, spark.createDataFrame([("running", None)], schema), 30)
    assert status.read_status(spark, folder, 99).first().result is None
    (tmp_path / "status" / "broken.json").write_text("{", encoding="utf-8")
    assert status.read_status(spark, folder, 99).first().status == "running"


def test_months_are_pruned(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), by_month=True)
    assert c.read_month("2026-03").count() == 0
    dates = ("2026.03.01", "2026-03-02", " 2026.03.03", "2026/03/04", "2026.04.01", "待定")
    c.upsert(spark.createDataFrame([(str(k), "t", "", d, *[""] * 6, False, True, 1, k) for k, d in enumerate(dates)], _with_ord()))
    assert sorted(r.id for r in c.read_month("2026-03").collect()) == ["0", "1"] and c.read().count() == 6 and c.read().columns == LISTING.names
    assert "PartitionFilters: [isnotnull(month" in c.read_month("2026-03")._jdf.queryExecution().executedPlan().toString()


def test_a_broken_store_is_an_error_and_no_empty_table(spark, tmp_path):
    (tmp_path / "versions").mkdir()
    (tmp_path / "versions" / "part.parquet").write_text("no parquet", encoding="utf-8")
    with pytest.raises(Exception):  # noqa: B017  whatever Spark raises
        store.Catalogue(spark, str(tmp_path)).read().count()


def test_merged_uploads(spark, tmp_path):
    """Existing rows win, an upload enriches them, a row of a changed date replaces its older self, and bad rows are put aside."""
    c = store.Catalogue(spark, str(tmp_path / "t"))
    row = lambda i, title, date, artist, k, price="": (i, title, "", date, "上海", "", price, "", "", artist, False, True, 1, k)
    c.upsert(spark.createDataFrame([row("b", "Foo Foo", "2026.05.01", "", 0, "80"), row("a", "Foo Foo", "2026.05.01 20:00", "", 1), row("m", "Moved", "2026.05.02", "M", 2)], _with_ord()))
    files = [[row("x", "foo foo", "2026-05-01", "P", 0), row("m", "Moved", "2026.06.02", "M", 1)], [row("y", "other", "2026.05.01", "P", 0, "99"), row("", "no id", "2026.05.01", "", 1)]]
    for rows in files:
        spark.createDataFrame(rows, _with_ord()).withColumnRenamed("updated_at", "updatedAt").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    q = uploads_.upsert_stream(uploads_.uploads(spark, str(tmp_path / "in"), max_files=1), c, str(tmp_path / "p"), smart=True, quarantine=str(tmp_path / "bad"))
    q.awaitTermination()
    assert len([p for p in q.recentProgress if p.numInputRows]) == 2
    got = {r.id: (r.title, r.artist, r.date, r.price) for r in c.read().collect()}
    assert got == {"b": ("【P】Foo Foo", "P", "2026.05.01", "80"), "a": ("Foo Foo", "", "2026.05.01 20:00", ""), "m": ("Moved", "M", "2026.06.02", "")}
    assert [r.title for r in spark.read.json(str(tmp_path / "bad")).collect()] == ["no id"]


def test_source_c_dates(spark):
    for given, want in (("2026/02/07 - 2026/02/08", "2026.02.07"), ("2026/02/21 Sat 20:00", "2026.02.21"), ("2026-02-21", "2026-02-21"), (None, "")):
        assert one(spark, given, landing.first_day) == want


def test_jsonp(spark):
    f = lambda x: F.to_json(landing.unwrap_jsonp(x))
    assert one(spark, ' cb({"a":1});', f) == '{"a":1}' and one(spark, "nothing", f) is None


@pytest.mark.parametrize(
    ("found", "want"),
    [
        (("P", False, True), ("【P】t", "P", False, True)),
        (("P", True, None), ("t", "Unknown", True, True)),
        (("P", None, False), ("t", "Unknown", False, False)),
        ((None, None, None), ("t", "Unknown", False, True)),
    ],
)
def test_extraction(spark, found, want):
    rows = spark.createDataFrame([("t", "", False, True), ("other", "A", True, None)], "title string, artist string, is_tribute boolean, is_famous boolean")
    x = spark.createDataFrame([("t", *found)], "title string, artist string, is_tribute boolean, is_famous boolean")
    got = classify.apply_extraction(rows, x).collect()
    assert tuple(next(r for r in got if r.title != "other")) == want
    assert tuple(next(r for r in got if r.title == "other")) == ("other", "A", True, None)


def test_extractor_batches_fail_alone(spark):
    rows = spark.createDataFrame([("good",), ("bad",)], "title string")

    def find(titles):
        if "bad" in titles:
            raise RuntimeError
        return {t: "P" for t in titles}

    assert [r.artist for r in classify.extract(rows, find, batch=1).collect()] == ["P"]


def test_uploads_are_reported(spark, tmp_path):
    catalogue = store.Catalogue(spark, str(tmp_path / "table"), buckets=2)
    schema = "id string, title string, date string, ord long"

    def upload(name, rows, **how):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / name / "in"))
        uploads_.upsert_stream(uploads_.uploads(spark, str(tmp_path / name / "in")), catalogue, str(tmp_path / name / "progress"), reports=str(tmp_path / name / "reports"), **how).awaitTermination()
        r = uploads_.read_reports(spark, str(tmp_path / name / "reports")).first()
        return r.success, r.mode, r.received, r.refused, r.total, r.total_new

    day = "2026.01.01"
    assert upload("a", [("1", "t", day, 1), ("2", "u", day, 2), ("", "v", day, 3)]) == (True, "upsert", 3, 1, 2, 2)
    assert upload("b", [("2", "t", day, 1), ("3", "w", day, 2)]) == (True, "upsert", 2, 0, 3, 1)
    assert upload("c", [("9", "t", day, 1)], mode="replace") == (True, "replace", 1, 0, 1, 1)
    assert upload("d", [("", "t", day, 1)], mode="replace") == (False, "replace", 1, 1, 1, 0)
    assert [r.id for r in catalogue.read().collect()] == ["9"]
    with pytest.raises(ValueError):
        uploads_.upsert_stream(uploads_.uploads(spark, str(tmp_path / "d" / "in")), catalogue, str(tmp_path / "x"), mode="none")


def test_extractor_batches_that_hang_are_left_out(spark):
    rows = spark.createDataFrame([("good",), ("slow",)], "title string").coalesce(1)

    def find(titles):
        import time

        if "slow" in titles:
            time.sleep(60)
        return {t: "P" for t in titles}

    assert [r.title for r in classify.extract(rows, find, batch=1, seconds=1).collect()] == ["good"]


def test_routing(spark):
    rows = spark.createDataFrame([("致敬 x", "P", None), ("x", "P", None), ("【P】x", "P", None), ("x", "群星", None), ("x", "", None)], "title string, artist string, is_tribute boolean")
    got = [(r.route, r.title, r.artist, r.is_tribute) for r in classify.route(rows).collect()]
    assert got == [("tribute", "致敬 x", "Unknown", True), ("official", "【P】x", "P", False), ("official", "【P】x", "P", False), ("extract", "x", "群星", False), ("extract", "x", "", False)]


def test_holidays(spark):
    days = spark.sql("SELECT * FROM VALUES (DATE'2026-01-01'), (DATE'2026-01-04'), (DATE'2026-01-10'), (DATE'2026-01-12'), (DATE'2026-09-20') AS t(day)")
    special = calendar.holidays(spark)
    assert special.count() == 39
    got = {str(r.day): (r.type, r.name, r.is_special) for r in calendar.day_status(days, special).collect()}
    assert got == {"2026-01-01": ("holiday", "元旦", True), "2026-01-04": ("workday", "补班", True), "2026-01-10": ("holiday", None, False), "2026-01-12": ("workday", None, False), "2026-09-20": ("workday", "补班", True)}


def test_progress_and_backoff(spark):
    row = spark.range(1).select(control.progress(F.lit(100), F.lit(0), F.lit(0)).alias("a"), control.progress(F.lit(18), F.lit(0), F.lit(100)).alias("b")).first()
    assert tuple(row) == (55, 29)
    waits = spark.range(5).select(control.backoff(F.col("id"), "a"), control.backoff(F.col("id"), "bc")).collect()
    assert [tuple(r) for r in waits] == [(2000, 800), (4000, 1600), (8000, 3200), (16000, 6000), (16000, 6000)]


def test_titles(spark):
    row = spark.createDataFrame([("【P】x", "P"), ("【P】x", "Q")], "t string, a string").select(text.card_title(F.col("t"), F.col("a")).alias("c"), text.short_title(F.col("t")).alias("s")).collect()
    assert [tuple(r) for r in row] == [("x", "x"), ("【P】x", "x")]


def test_first_seen_in_a_stream(spark, tmp_path):
    from marquee.streaming.uploads import first_seen

    rows = [("x", "1", "2026-01-01 00:00:00"), ("x", "1", "2026-01-01 00:01:00"), ("y", "1", "2026-01-01 00:01:00")]
    spark.createDataFrame(rows, "city string, id string, at string").write.json(str(tmp_path / "in"))
    source = spark.readStream.schema("city string, id string, at timestamp").json(str(tmp_path / "in"))
    q = first_seen(source, ["city", "id"], "at").writeStream.format("memory").queryName("first_seen").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("first_seen").count() == 2
