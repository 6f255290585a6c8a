"""The merge against hand cases and against a plain scan of whole lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from marquee.operators import merge as m

DAY = "2026.05.01"
SCHEMA = "id string, title string, date string, city string, artist string, ord long"


def frame(spark, rows):
    return spark.createDataFrame([(f"i{k}", r.get("title", "Some Show"), r.get("date", DAY), r.get("city", "上海"), r.get("artist", ""), k) for k, r in enumerate(rows)], SCHEMA)


def both(spark, a, b):
    return [(r.title, r.artist, r.action) for r in m.merge(frame(spark, a), frame(spark, b)).orderBy("side", "ord").collect()]


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        (dict(artist="P"), dict(artist="P", city="上海市"), True),
        (dict(artist="P"), dict(artist="Q"), False),
        (dict(artist="Unknown", title="One"), dict(artist="Unknown", title="Two"), True),
        (dict(artist="Unknown"), dict(artist="P"), False),
        (dict(title="Foo Show 演唱会"), dict(artist="P", title="foo show"), True),
        (dict(artist="P", city=""), dict(artist="P", city="北京"), True),
        (dict(artist="P", date="2026-05-01"), dict(artist="P"), True),
        (dict(artist="P", date="2026/05/01"), dict(artist="P", date="2026/05/01"), False),
        (dict(artist="P", date="时间待定"), dict(artist="P", date="时间待定"), False),
    ],
)
def test_duplicate_predicate(spark, a, b, same):
    assert (m.duplicate_pairs(frame(spark, [a]), frame(spark, [b])).count() == 1) is same
    assert (len(both(spark, [a], [b])) == 1) is same


def test_enrichment(spark):
    assert both(spark, [dict(title="Foo Foo 演唱会")], [dict(title="foo foo", artist="P")]) == [("【P】Foo Foo 演唱会", "P", "kept+enriched")]
    assert both(spark, [dict(title="【旧】Foo Foo")], [dict(title="foo foo", artist="P")])[0][0] == "【P】Foo Foo"


def test_secondary_rows_merge_among_themselves_but_primary_rows_do_not(spark):
    x = dict(artist="P")
    assert len(both(spark, [], [x, x])) == 1
    assert len(both(spark, [x, x], [])) == 2


def test_an_enriched_row_absorbs_by_artist(spark):
    out = both(spark, [dict(title="foo foo")], [dict(title="foo foo", artist="P"), dict(title="unrelated", artist="P")])
    assert len(out) == 1


def test_undated_rows_are_added_again(spark):
    x = [dict(date="TBD"), dict(artist="P")]
    assert len(both(spark, x, x)) == 3


def test_empty_lists(spark):
    assert both(spark, [], []) == []


def plain(primary, secondary):
    """The whole lists in one loop, without blocks."""
    key = lambda d: (re.search(r"[0-9]{4}[.-][0-9]{2}[.-][0-9]{2}", d) or [""])[0].replace("-", ".")
    out = [dict(r) for r in primary]
    for row in map(dict, secondary):
        def same(o, row=row):
            if not key(o["date"]) or key(o["date"]) != key(row["date"]) or not (o["city"] in row["city"] or row["city"] in o["city"]):
                return False
            if o["artist"] and row["artist"]:
                return o["artist"] == row["artist"]
            a, b = m.plain_title(o["title"]), m.plain_title(row["title"])
            a, b = (o["title"], row["title"]) if min(len(a), len(b)) < 2 else (a, b)
            return a in b or b in a
        hit = next((o for o in out if same(o)), None)
        if hit is None:
            out.append(row)
        elif (not hit["artist"] or hit["artist"] in m.EMPTY_ARTISTS) and row["artist"] and row["artist"] not in m.EMPTY_ARTISTS:
            hit["artist"] = row["artist"]
            if row["artist"] not in hit["title"]:
                hit["title"] = f"【{row['artist']}】" + re.sub("^【.*?】", "", hit["title"])
    return [(o["title"], o["artist"]) for o in out]


@pytest.mark.parametrize("seed", range(3))
def test_equals_a_scan_of_whole_lists(spark, seed):
    r = random.Random(seed)
    make = lambda n: [dict(title=r.choice(["Alpha", "alpha tour", "Beta 2026", "【Q】Beta", "x", "Gamma"]), artist=r.choice(["", "", "P", "Q", "Unknown", "群星"]), city=r.choice(["上海", "上海市", "北京", ""]), date=r.choice([DAY, "2026-05-01 周五", "2026.05.02", "TBD"])) for _ in range(n)]
    a, b = make(25), make(60)
    assert [x[:2] for x in both(spark, a, b)] == plain(a, b)


def test_counts_on_the_order_tables(spark):
    from marquee.plans.catalogue import _sources

    a, b, c = _sources(spark, "/root/testdata/sf0.01")
    ab = m.merge(a, b)
    assert m.summary(ab, a.count()).first()[:3] == (4743, 19, 9743)
    combined = ab.withColumn("ord", F.col("side").cast("long") * F.lit(1 << 52) + F.col("ord")).drop("side", "action")
    assert m.summary(m.merge(combined, c), ab.count()).first()[:3] == (4567, 34, 14310)


TITLES = ["Alpha", "alpha tour", "Beta 2026", "【Q】Beta", "x", "Gamma", "【P】x", "】x", "P】", "【P】", "LIVE 2026", "P", "【旧】Alphabet", "Q】Beta", "ga", "Gam", "【P】Live", "阿", ""]


@pytest.mark.parametrize("seed", range(4))
def test_components_equal_a_scan_of_whole_lists(spark, seed):
    """Crowded dates, with titles that only brackets or enriched titles connect."""
    r = random.Random(seed)
    make = lambda n: [dict(title=r.choice(TITLES), artist=r.choice(["", "", "", "P", "Q", "Unknown", "群星", "Be】x"] if seed else ["", "P"]), city=r.choice(["上海", "上海市", "北京", ""]), date=r.choice([DAY, "2026-05-01 周五", "2026.05.02", "TBD"])) for _ in range(n)]
    a, b = make(12), make(45)
    out = m.merge(frame(spark, a), frame(spark, b), crowded=3).orderBy("side", "ord").collect()
    assert [(x.title, x.artist) for x in out] == plain(a, b)


@pytest.mark.parametrize("seed", range(2))
def test_pairs_of_crowded_dates(spark, seed):
    r = random.Random(seed)
    make = lambda n: frame(spark, [dict(title=r.choice(TITLES), artist=r.choice(["", "", "P", "Q", "Unknown"]), city=r.choice(["上海", "上海市", "北京", ""]), date=r.choice([DAY, "2026.05.02", "2026.05.03", "TBD"])) for _ in range(n)])
    a, b = make(40), make(40)
    ids = lambda crowded: sorted((x.a, x.b) for x in m.duplicate_pairs(a, b, crowded).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b")).collect())
    assert ids(15) == ids(10**9) == ids(1) and len(ids(1)) > 50
    news = lambda crowded: sorted(x.ord for x in m.new_rows(a, b, crowded).collect())
    assert news(1) == news(10**9)


def test_needles_meet_few_hays(spark):
    from marquee.operators import containment

    words = [f"{a}{b}show" for a in "abcdefghijklmnop" for b in "abcdefghijklmnopqrstuvwxyz"]
    hays = spark.createDataFrame([("d", w) for w in words], "day string, text string")
    needles = spark.createDataFrame([("d", w) for w in ("abs", "zz", "p", "", "acshow", "acshows")], "day string, text string")
    got = sorted((x.needle, x.hay) for x in containment.contained(needles, hays, ["day"]).collect())
    assert got == sorted((n, w) for n in ("abs", "zz", "p", "", "acshow", "acshows") for w in words if n in w)
    rows = containment.contained(hays, hays, ["day"])
    assert rows.count() == len(words)


def test_a_crowded_date_spreads(spark):
    """Four thousand rows of one date in two thousand scans, with the rows of the scan of the whole date."""
    a = spark.range(2000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("show "), F.md5(F.col("id").cast("string"))).alias("title"), F.lit(DAY).alias("date"), F.lit("").alias("city"), F.lit("").alias("artist"), F.col("id").alias("ord"))
    b = a.withColumn("id", F.concat(F.lit("b"), "id")).withColumn("artist", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("P"), F.col("ord").cast("string"))).otherwise(""))
    whole, parts = (m.merge(a, b, n) for n in (10**9, 1000))
    assert parts.exceptAll(whole).isEmpty() and whole.exceptAll(parts).isEmpty() and parts.count() == 2000
    both = a.withColumn("side", F.lit(0)).unionByName(b.withColumn("side", F.lit(1))).withColumn("start_date", F.lit(DAY))
    assert m._by_component(both, spark.createDataFrame([(DAY,)], "start_date string")).select("scan").distinct().count() == 2000


def test_rows_that_repeat_are_compared_once(spark):
    """30,000 rows of a date on either side, of a few kinds: 900 million pairs of rows, and some ten of kinds."""
    rows = lambda side: spark.range(30_000).select(F.concat(F.lit(side), F.col("id").cast("string")).alias("id"), F.lit("Some Show").alias("title"), F.lit(DAY).alias("date"), F.when(F.col("id") % 2 == 0, "上海").alias("city"), F.when(F.col("id") % 3 == 0, side.upper()).alias("artist"), F.col("id").alias("ord"))
    a, b = rows("a"), rows("b")
    # Named rows of both sides differ in their artists, all others match by title.
    first = m.first_match(a, b)
    assert first.count() == 30_000 and {x.match_id for x in first.select("match_id").distinct().collect()} == {"a0", "a1"}
    assert m.new_rows(a, b).isEmpty()
    assert m.enrich_artist(a, b).groupBy("artist").count().collect() == [("B", 20_000)]
    assert m._kinds(a, [F.count(F.lit(1)).alias("n")]).count() == 4


def test_lists_of_a_large_kind_are_cut(spark):
    few, many = frame(spark, [dict(artist="P")] * 3), frame(spark, [dict(artist="P")] * (2 * m.HELD + 500))
    got = m.duplicate_pairs(few, many).select(F.col("a.ord").alias("a"), F.col("b.ord").alias("b"))
    assert got.distinct().count() == got.count() == 3 * (2 * m.HELD + 500)


def test_null_titles_match_by_artist_alone(spark):
    rows = lambda *titles: spark.createDataFrame([(f"i{k}", t, DAY, None, "P", k) for k, t in enumerate(titles)], SCHEMA)
    a, b = rows(None), rows(None, "x", "Some Show")
    assert sorted(x.id for x in m.first_match(a, b).collect()) == ["i0", "i1", "i2"]
    assert m.duplicate_pairs(a, b).count() == 3 and m.new_rows(a, b).isEmpty()


@pytest.mark.parametrize(("seed", "crowded"), [(0, 10**9), (1, 10**9), (2, 3)])
def test_all_sources_are_merged_in_one_scan(spark, seed, crowded):
    """Three sources and the existing list, against a merge a step; there is one pass over the rows."""
    r = random.Random(seed)
    make = lambda n: frame(spark, [dict(title=r.choice(TITLES), artist=r.choice(["", "", "", "P", "Q", "Unknown", "群星", "Be】x"]), city=r.choice(["上海", "上海市", "北京", ""]), date=r.choice([DAY, "2026-05-01 周五", "2026.05.02", "TBD"])) for _ in range(n)])
    existing, a, b, c = make(10), make(12), make(25), make(25)
    out = m.merge_all(existing, [a, b, c], crowded)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    combined = a
    for step, source in enumerate([b, c], 1):
        combined = m.merge(combined, source, 10**9).withColumn("ord", F.col("side").cast("long") * F.lit(step << 52) + F.col("ord")).drop("side", "action")
    wanted = m.merge(existing, combined, 10**9)
    rows = lambda x: [tuple(r) for r in x.select("id", "title", "artist", "side", "ord", "action").orderBy("side", "ord").collect()]
    assert rows(out) == rows(wanted)


def test_a_row_looks_at_kinds_and_not_at_rows(spark, monkeypatch):
    """20,000 rows on either side of a date: 400 million pairs of rows, and a few texts."""
    looks = []
    alike = m._alike
    monkeypatch.setattr(m, "_alike", lambda a, b: looks.append(1) or alike(a, b))
    n = 20_000
    scan = m._Scan(["上海"] * 2 * n, [""] * n + ["P", "Q"] * (n // 2), ["Some Show"] * n + ["Some Show", "Other Event"] * (n // 2))
    stay, changed = scan.merge(list(range(n)), list(range(n, 2 * n)))
    # The first row takes P and absorbs all of P; rows of Q are of another text, and one of them stays.
    assert stay == [*range(n), n + 1] and changed == {0} and scan.artist[0] == "P" and len(looks) <= 10


def test_a_null_title_and_a_null_date(spark):
    rows = spark.createDataFrame([("a", None, DAY, None, "P", 0), ("b", "x", None, None, "", 1), ("c", None, DAY, None, "", 2)], SCHEMA)
    out = m.merge(rows, rows.withColumn("ord", F.col("ord") + 10)).orderBy("side", "ord").collect()
    assert [(x.id, x.title, x.action) for x in out] == [("a", None, "kept"), ("b", "x", "kept"), ("c", None, "kept"), ("b", "x", "new"), ("c", None, "new")]


def test_a_summary_needs_no_count_of_the_primary_list(spark):
    a, b = frame(spark, [dict(title="foo foo"), dict(title="bar bar")]), frame(spark, [dict(title="foo foo", artist="P"), dict(title="new one")])
    merged = m.merge(a, b)
    assert m.summary(merged).collect() == m.summary(merged, 2).collect() and m.summary(merged).first().total_new == 1
