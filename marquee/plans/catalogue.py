"""Named queries of the catalogue over the driver's tables, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marquee.folders import scratch
from marquee.functions import dates, text
from marquee.operators import calendar, classify, control, listings as ops, merge, pages, store
from marquee.plans.listings_view import LISTINGS_SQL, listings
from marquee.schema import CITY_BLACKLIST, EMPTY_ARTISTS, NOISE_TAGS, LOCATIONS_C, PAGE_B, PAGE_C, STATUS, TRIBUTE_WORDS, WEEKDAYS
from marquee.sources import landing, paging, status
from marquee.streaming.transitions import transition_stream
from marquee.streaming.uploads import first_seen, read_reports, uploads, upsert_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

COLUMNS = "id, title, image, date, city, venue, price, status, category, artist, is_tribute, is_famous, updated_at"
AS_OF = "2026-01-01"
WEEK_OF = "1996-03-06"


def query(sql: str | None = None, view: bool = True):
    """Registers a function under its name; its SQL starts behind the listings view unless ``view`` is off."""

    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (LISTINGS_SQL + sql) if view else sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {sql}")


def _cols(df: DataFrame, names: str = COLUMNS) -> DataFrame:
    return df.select(*names.split(", "))


# SQL of expressions that several queries share.

_BL = r"[\s\x{000B}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+"


def norm_sql(c: str) -> str:
    out = f"lower({c})"
    for noise in (_BL, "【.*?】", r"\[.*?\]", r"\(.*?\)", "[0-9]{4}", "演唱会|巡回|站|世界|live|tour|concert"):
        out = f"regexp_replace({out}, '{noise}', '', 'g')"
    return out


def start_sql(c: str) -> str:
    return f"replace(regexp_extract({c}, '([0-9]{{4}}[.\\-][0-9]{{2}}[.\\-][0-9]{{2}})', 1), '-', '.')"


def list_sql(terms) -> str:
    return "[" + ", ".join(f"'{t}'" for t in terms) + "]"


def any_sql(c: str, terms) -> str:
    return f"len(list_filter({list_sql(terms)}, lambda t: contains({c}, t))) > 0"


_D = r"([0-9]{4})[-./]([0-9]{1,2})[-./]([0-9]{1,2})"
_T = r"([0-9]{2}):([0-9]{2})"
_KEY = "coalesce(nullif(split_part(date, ' ', 1), ''), '9999.99.99')"
#: Listings as events, after the listings view.
EVENTS_SQL = f""", P AS (
  SELECT *, regexp_extract(date, '{_D}', 1) AS y, regexp_extract(date, '{_D}', 2) AS m, regexp_extract(date, '{_D}', 3) AS dd,
         regexp_extract(date, '{_T}', 1) AS hh, regexp_extract(date, '{_T}', 2) AS mi FROM L),
E AS (
  SELECT id, title, artist, y = '' AS is_fallback,
    CASE WHEN y = '' THEN TIMESTAMP '{AS_OF} 00:00:00'
      ELSE make_date(CAST(y AS INT), 1, 1) + to_months(CAST(m AS INT) - 1) + to_days(CAST(dd AS INT) - 1) END
    + to_minutes(CASE WHEN hh = '' THEN 1170 ELSE CAST(hh AS INT) * 60 + CAST(mi AS INT) END) AS start
  FROM P)
"""
#: Keyed primary (src 0) and secondary (src 1) rows and the pairs that match.
PAIRS_SQL = f""", N AS (SELECT *, {start_sql("date")} AS sd, {norm_sql("title")} AS nt FROM L),
PAIRS AS (
  SELECT a.id AS id_a, b.id AS id_b, a.ord AS ord_a, b.ord AS ord_b, a.artist AS artist_a, b.artist AS artist_b, a.title AS title_a
  FROM N a JOIN N b ON a.sd = b.sd AND a.sd <> '' AND a.src = 0 AND b.src = 1
  WHERE (contains(a.city, b.city) OR contains(b.city, a.city))
    AND CASE WHEN a.artist <> '' AND b.artist <> '' THEN a.artist = b.artist
      WHEN length(a.nt) < 2 OR length(b.nt) < 2 THEN contains(a.title, b.title) OR contains(b.title, a.title)
      ELSE contains(a.nt, b.nt) OR contains(b.nt, a.nt) END)
"""


_EMPTY = list_sql(("", *EMPTY_ARTISTS))
_NEW_TITLE = "CASE WHEN contains(x.title, artist) THEN x.title ELSE '【' || artist || '】' || regexp_replace(x.title, '^【.*?】', '') END"
_FIELDS = ("id", "side", "ord", "title", "nt", "city", "date", "artist")


def _struct(**changed: str) -> str:
    return "{" + ", ".join(f"'{f}': {changed.get(f, 'x.' + f)}" for f in (*_FIELDS, "enriched")) + "}"


def merge_sql(n: int, source: str) -> str:
    """CTEs that merge a source (id, title, artist, city, date, side, ord) into M{n}, with action.

    One step for each secondary row of a date; the state is the date's list so far.
    """
    own = _struct(**{f: f for f in _FIELDS}, enriched="false")
    renamed = _struct(title=_NEW_TITLE, nt=norm_sql(f"({_NEW_TITLE})"), artist="artist", enriched="true")
    return f""", N{n} AS (SELECT *, {start_sql("date")} AS sd, {norm_sql("title")} AS nt FROM ({source})),
S{n} AS (SELECT *, row_number() OVER (PARTITION BY sd ORDER BY ord) AS step FROM N{n} WHERE side = 1 AND sd <> ''),
R{n}(sd, k, m) AS (
  SELECT sd, 0::BIGINT, coalesce(list({own} ORDER BY ord) FILTER (side = 0), []) FROM N{n} WHERE sd <> '' GROUP BY sd
  UNION ALL
  SELECT sd, step, CASE WHEN hit IS NULL THEN list_append(m, {own})
    WHEN list_contains({_EMPTY}, m[hit].artist) AND NOT list_contains({_EMPTY}, artist)
      THEN list_transform(m, lambda x, i: CASE WHEN i = hit THEN {renamed} ELSE x END)
    ELSE m END
  FROM (
    SELECT R.m, S.*, list_filter(range(1, len(R.m) + 1), lambda i:
        (contains(R.m[i].city, S.city) OR contains(S.city, R.m[i].city))
        AND CASE WHEN R.m[i].artist <> '' AND S.artist <> '' THEN R.m[i].artist = S.artist
          WHEN length(R.m[i].nt) < 2 OR length(S.nt) < 2 THEN contains(R.m[i].title, S.title) OR contains(S.title, R.m[i].title)
          ELSE contains(R.m[i].nt, S.nt) OR contains(S.nt, R.m[i].nt) END)[1] AS hit
    FROM R{n} AS R JOIN S{n} AS S ON R.sd = S.sd AND S.step = R.k + 1)),
M{n} AS (
  SELECT x.id, x.title, x.artist, x.city, x.date, x.side, x.ord,
    CASE WHEN x.side = 0 THEN 'kept' ELSE 'new' END || CASE WHEN x.enriched THEN '+enriched' ELSE '' END AS action
  FROM (SELECT unnest(m) AS x FROM (SELECT sd, arg_max(m, k) AS m FROM R{n} GROUP BY sd))
  UNION ALL SELECT id, title, artist, city, date, side, ord, CASE WHEN side = 0 THEN 'kept' ELSE 'new' END FROM N{n} WHERE sd = '')
"""


def _after(n: int) -> str:
    """M{n} as the primary list of the next merge with source n + 1."""
    rest = f"SELECT id, title, artist, city, date, 1, ord FROM L WHERE src = {n + 1}"
    return f"SELECT id, title, artist, city, date, 0 AS side, CAST(side AS BIGINT) * {n << 52} + ord AS ord FROM M{n} UNION ALL {rest}"


MERGE_SQL = LISTINGS_SQL.replace("WITH L0", "WITH RECURSIVE L0", 1) + merge_sql(1, "SELECT id, title, artist, city, date, src AS side, ord FROM L WHERE src < 2")
#: Half of the first source is there already when the three, merged in turn, come.
MERGE_ALL_SQL = MERGE_SQL + merge_sql(2, _after(1)) + merge_sql(
    3,
    f"""SELECT id, title, artist, city, date, 0 AS side, ord FROM L WHERE src = 0 AND ord % 4 < 2
    UNION ALL SELECT id, title, artist, city, date, 1, CAST(side AS BIGINT) * {2 << 52} + ord FROM M2""",
)
_STORED = "SELECT id, title, artist, city, date, 0 AS side, row_number() OVER (ORDER BY date, id) AS ord FROM"
_UPLOAD = "SELECT id, title, artist, city, date, 1, ord FROM L WHERE src ="
#: Two uploads after each other into a table that holds the first source.
UPLOADS_SQL = (
    LISTINGS_SQL.replace("WITH L0", "WITH RECURSIVE L0", 1)
    + merge_sql(1, f"{_STORED} L WHERE src = 0 UNION ALL {_UPLOAD} 1")
    + merge_sql(2, f"{_STORED} M1 UNION ALL {_UPLOAD} 2")
)


# --- scans, filters, order, pages -------------------------------------------------------


@query(f"SELECT {COLUMNS} FROM L ORDER BY date")
def scan_all(spark, sf_dir):
    return _cols(listings(spark, sf_dir)).orderBy("date")


@query(f"SELECT {COLUMNS} FROM L WHERE date LIKE '1996-03%' OR date LIKE '1996.03%'")
def scan_month(spark, sf_dir):
    return _cols(ops.scan_month(listings(spark, sf_dir), "1996-03")).orderBy("date")


@query("SELECT count(*) AS n FROM L")
def count_all(spark, sf_dir):
    return listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, title, date FROM (SELECT CASE WHEN ord % 17 = 0 THEN '' ELSE id END AS id, title, CASE WHEN ord % 19 <> 0 THEN date END AS date FROM L) WHERE id <> '' AND title <> '' AND date <> ''")
def validate_required(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumns({"id": F.when(F.col("ord") % 17 == 0, "").otherwise(F.col("id")), "date": F.when(F.col("ord") % 19 != 0, F.col("date"))})
    return store.valid_upload(rows)[0].select("id", "title", "date")


@query("SELECT id, city FROM L WHERE contains(city, 'NATION_1')")
def filter_city_contains(spark, sf_dir):
    return listings(spark, sf_dir).filter(ops.city_contains("NATION_1")).select("id", "city")


_CUT = "SELECT id, split_part(title, ' NATION', 1) AS title, venue, city, artist FROM L"


def _untold(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("title", F.split_part("title", F.lit(" NATION"), F.lit(1)))


@query(f"SELECT id, title FROM ({_CUT}) WHERE contains(lower(title), 'nation_2') OR contains(lower(venue), 'nation_2') OR contains(lower(city), 'nation_2') OR contains(lower(artist), 'nation_2')")
def search_api(spark, sf_dir):
    return _untold(spark, sf_dir).filter(ops.search("nation_2")).select("id", "title")


@query(f"SELECT id, venue FROM ({_CUT}) WHERE contains(lower(title), 'hall 7') OR contains(lower(venue), 'hall 7') OR contains(lower(artist), 'hall 7')")
def search_client(spark, sf_dir):
    return _untold(spark, sf_dir).filter(ops.search("HALL 7", ("title", "venue", "artist"))).select("id", "venue")


@query("SELECT id, city, artist FROM L WHERE city = 'NATION_1' AND artist = 'BUILDING' AND (contains(lower(title), 'tour') OR contains(lower(venue), 'tour') OR contains(lower(artist), 'tour'))")
def facet_filter(spark, sf_dir):
    return listings(spark, sf_dir).filter(ops.facet("NATION_1", "BUILDING", "Tour")).select("id", "city", "artist")


@query("SELECT c_custkey, code FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CN' WHEN 1 THEN 'HK' WHEN 2 THEN '' END AS code FROM customer) WHERE code IS DISTINCT FROM 'CN'", view=False)
def filter_not_equal_nullsafe(spark, sf_dir):
    k = F.col("c_custkey") % 4
    code = F.when(k == 0, "CN").when(k == 1, "HK").when(k == 2, "")
    return table(spark, sf_dir, "customer").select("c_custkey", code.alias("code")).filter(~F.col("code").eqNullSafe("CN"))


_SPOTS = "SELECT id, CASE ord % 4 WHEN 0 THEN city || '伦敦' WHEN 1 THEN '迪拜' ELSE city END AS city FROM L"


@query(f"SELECT id, city FROM ({_SPOTS}) WHERE NOT ({any_sql('city', CITY_BLACKLIST)})")
def blacklist_filter(spark, sf_dir):
    spots = listings(spark, sf_dir).withColumn("city", F.when(F.col("ord") % 4 == 0, F.concat("city", F.lit("伦敦"))).when(F.col("ord") % 4 == 1, "迪拜").otherwise(F.col("city")))
    return ops.not_blacklisted(spots).select("id", "city")


@query(f"SELECT id, title, date, {_KEY} AS sort_key FROM L ORDER BY {_KEY}, date, id")
def sorted_listing(spark, sf_dir):
    return ops.in_order(listings(spark, sf_dir).select("id", "title", "date", ops.sort_key().alias("sort_key")))


@query(f"SELECT {COLUMNS} FROM L WHERE (date LIKE '1996-03%' OR date LIKE '1996.03%') AND (contains(lower(title), 'tour') OR contains(lower(venue), 'tour') OR contains(lower(city), 'tour') OR contains(lower(artist), 'tour')) ORDER BY {_KEY}, date, id LIMIT 5 OFFSET 5")
def page_n(spark, sf_dir):
    found = ops.scan_month(listings(spark, sf_dir), "1996-03").filter(ops.search("Tour"))
    return ops.page(_cols(found), 2, 5)


@query("SELECT true AS success, count(*) AS total, 2 AS page, 5 AS page_size, CAST(ceil(count(*) / 5.0) AS BIGINT) AS total_pages FROM L WHERE date LIKE '1996-03%' OR date LIKE '1996.03%'")
def page_envelope(spark, sf_dir):
    return ops.envelope(ops.scan_month(listings(spark, sf_dir), "1996-03"), 2, 5)


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) WHERE r <= 2", view=False)
def topk_per_location(spark, sf_dir):
    return ops.top_of_each(table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal"), "s_nationkey", [F.desc("s_acctbal"), "s_suppkey"], 2)


@query(
    """WITH n AS (SELECT *, n_nationkey % 7 AS same FROM nation), w(name) AS (VALUES ('City 2'), ('City 6'), ('City 9'))
SELECT name AS city, CAST(coalesce(
    (SELECT min(n_nationkey) FROM n WHERE n_nationkey < 5 AND 'City ' || same = name),
    (SELECT arg_min(n_nationkey, n_regionkey * 100 + n_nationkey) FROM n WHERE n_nationkey >= 5 AND 'City ' || same = name)) AS VARCHAR) AS id FROM w WHERE name <> 'City 9'""",
    view=False,
)
def priority_lookup(spark, sf_dir):
    """City 2 is a hot city, City 6 one of the groups alone, City 9 none."""
    cities = landing.city_list(_city_bodies(spark, sf_dir, F.concat(F.lit("City "), F.col("n_nationkey") % 7)))
    found = [landing.find_city(cities, name).select(F.col("cityName").alias("city"), F.col("cityId").alias("id")) for name in ("City 2", "City 6", "City 9")]
    return found[0].unionByName(found[1]).unionByName(found[2])


# --- facets and other aggregates ----------------------------------------------------------


@query("SELECT city, count(*) AS n, min(ord) AS first_ord FROM L GROUP BY city")
def city_stats(spark, sf_dir):
    return ops.counts(listings(spark, sf_dir), "city")


@query("SELECT artist, count(*) AS n, min(ord) AS first_ord FROM L WHERE artist <> '' AND artist <> 'Unknown' GROUP BY artist")
def artist_stats(spark, sf_dir):
    return ops.counts(ops.named_artists(listings(spark, sf_dir)), "artist")


@query("SELECT count(*) AS total, count(*) FILTER (WHERE city = 'NATION_1') AS in_city, count(*) FILTER (WHERE artist = 'BUILDING') AS of_artist FROM L")
def facet_totals(spark, sf_dir):
    return listings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"), F.count_if(ops.facet(city="NATION_1")).alias("in_city"), F.count_if(ops.facet(artist="BUILDING")).alias("of_artist"))


# --- store ---------------------------------------------------------------------------------


@query("SELECT id, city, artist, is_tribute, coalesce(nullif(status, ''), 'Unknown') AS status, coalesce(nullif(category, ''), 'Concert') AS category, price, coalesce(is_famous, true) AS is_famous, updated_at FROM L")
def apply_defaults(spark, sf_dir):
    return store.with_defaults(listings(spark, sf_dir)).select("id", "city", "artist", "is_tribute", "status", "category", "price", "is_famous", "updated_at")


@query("SELECT id, user_id, event_id FROM (SELECT event_type AS id, user_id, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS r FROM events) WHERE r = 1", view=False)
def dedup_keep_first(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("id"), "user_id", "event_id")
    return store.keep_first(rows, ["user_id", "id"], "event_id")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1", view=False)
def dedup_keep_last(spark, sf_dir):
    return store.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id"], "event_id")


_INCOMING = "SELECT 'u' || CAST(ord % 500 AS VARCHAR) AS id, ord, title, city, status FROM L WHERE src = 1"
_EXISTING = "SELECT 'u' || CAST(ord % 700 AS VARCHAR) AS id, ord, title, city, status FROM L WHERE src = 0"


@query(
    f""", I AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM ({_INCOMING})) WHERE r = 1),
X AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM ({_EXISTING})) WHERE r = 1)
SELECT id, title, city, coalesce(nullif(status, ''), 'Unknown') AS status FROM I
UNION ALL SELECT id, title, city, status FROM X WHERE id NOT IN (SELECT id FROM I)"""
)
def upsert_keep_last(spark, sf_dir):
    rows = listings(spark, sf_dir)
    name = lambda n: F.concat(F.lit("u"), (F.col("ord") % n).cast("string"))
    old = store.keep_last(rows.filter("src = 0").withColumn("id", name(700)), ["id"])
    return store.upsert(old, rows.filter("src = 1").withColumn("id", name(500))).select("id", "title", "city", "status")


@query("SELECT id, title, coalesce(nullif(status, ''), 'Unknown') AS status FROM L WHERE src = 2")
def replace_mode(spark, sf_dir):
    empty = listings(spark, sf_dir).limit(0)
    return store.upsert(empty, listings(spark, sf_dir).filter("src = 2")).select("id", "title", "status")


@query(
    """, C AS (SELECT CAST(count(*) FILTER (WHERE src = 1) AS INTEGER) AS new, CAST(count(*) FILTER (WHERE src = 2) AS INTEGER) AS third FROM L)
SELECT CAST(0 AS INTEGER) AS step, 'idle' AS status, 0 AS progress, 0 AS total, 0 AS current, '' AS message, CAST(1000 AS BIGINT) AS "lastUpdated", CAST(NULL AS BOOLEAN) AS success, -1 AS new_rows
UNION ALL SELECT 1, 'completed', 100, 0, 0, 'done', 2000, true, new FROM C
UNION ALL SELECT 2, 'completed', 30, 0, third, 'done', 3000, true, new FROM C
UNION ALL SELECT 3, 'running', 0, 0, 0, 'start', 4000, NULL, -1"""
)
def status_merge(spark, sf_dir):
    """The default where no document is, a patch with a nested result, one without (which keeps it), and one that clears it."""
    result = "result struct<success boolean, totalNew int, totalCombined int, message string, timedOutSources array<string>, failedSources array<string>>"
    folder = scratch(spark, "status")
    n = listings(spark, sf_dir).agg(F.count(F.lit(1)), F.count_if(F.col("src") == 1), F.count_if(F.col("src") == 2)).first()
    patches = [
        spark.createDataFrame([("completed", 100, "done", (True, n[1], n[0], None, None, None))], f"status string, progress int, message string, {result}"),
        spark.createDataFrame([(30, n[2])], "progress int, current int"),
        spark.createDataFrame([("running", 0, 0, "start", None)], f"status string, progress int, current int, message string, {result}"),
    ]
    seen = [status.read_status(spark, folder, 1000)]
    for k, patch in enumerate(patches):
        status.update_status(spark, folder, patch, 2000 + 1000 * k)
        seen.append(spark.createDataFrame(status.read_status(spark, folder, 0).collect(), STATUS))  # one row, before the next document
    rows = [x.select(F.lit(k).alias("step"), "status", "progress", "total", "current", "message", "lastUpdated", "result.success", F.coalesce("result.totalNew", F.lit(-1)).alias("new_rows")) for k, x in enumerate(seen)]
    return reduce(DataFrame.unionByName, rows)


# --- the indexed table, pages far down ------------------------------------------------------

_MOVED = ", M AS (SELECT id, title, venue, artist, date, CASE WHEN src = 0 AND ord % 2 = 0 THEN 'NATION_2' ELSE city END AS city FROM L)"


def _indexed(spark, sf_dir) -> store.Catalogue:
    """All listings, and then an upsert that moves some of them to another city."""
    kept = store.Catalogue(spark, scratch(spark, "indexed"), buckets=8, indexed=True, cluster=("city", "artist"), file_rows=2048)
    rows = listings(spark, sf_dir)
    kept.upsert(rows)
    kept.upsert(rows.filter("src = 0 AND ord % 2 = 0").withColumn("city", F.lit("NATION_2")))
    return kept


@query(
    _MOVED
    + """
SELECT 'facet' AS asked, id, city, artist, title FROM M WHERE city = 'NATION_1' AND artist = 'BUILDING' AND contains(lower(title), 'tour 1996')
UNION ALL SELECT 'part', id, city, artist, title FROM M WHERE contains(city, 'ION_2') AND (date LIKE '1996-03%' OR date LIKE '1996.03%')
UNION ALL SELECT 'short', id, city, artist, title FROM M WHERE contains(venue, '4') AND city = 'NATION_3' AND artist = 'MACHINERY'"""
)
def stored_search(spark, sf_dir):
    kept = _indexed(spark, sf_dir)
    found = {
        "facet": kept.search(city="NATION_1", artist="BUILDING", words="TOUR 1996"),
        "part": kept.search(city_part="ION_2", month="1996-03"),
        "short": kept.search(city="NATION_3", artist="MACHINERY", words="4").filter(F.contains("venue", F.lit("4"))),
    }
    return reduce(DataFrame.unionByName, (rows.select(F.lit(k).alias("asked"), "id", "city", "artist", "title") for k, rows in found.items()))


@query(
    _MOVED
    + """
SELECT 'city' AS facet, 'all' AS month, city AS value, count(*) AS n FROM M GROUP BY city
UNION ALL SELECT 'artist', 'all', artist, count(*) FROM M GROUP BY artist
UNION ALL SELECT 'city', '1996-03', city, count(*) FROM M WHERE date LIKE '1996-03%' OR date LIKE '1996.03%' GROUP BY city"""
)
def stored_facets(spark, sf_dir):
    kept = _indexed(spark, sf_dir)
    asked = [("city", None), ("artist", None), ("city", "1996-03")]
    return reduce(DataFrame.unionByName, (kept.facets(c, m).select(F.lit(c).alias("facet"), F.lit(m or "all").alias("month"), "value", "n") for c, m in asked))


@query(f"SELECT {COLUMNS} FROM L ORDER BY {_KEY}, date, id LIMIT 20 OFFSET 1180")
def deep_page(spark, sf_dir):
    return _cols(pages.Ranked(spark, scratch(spark, "ranked"), range_rows=10_000).build(listings(spark, sf_dir)).page(60, 20))


@query(f"SELECT {COLUMNS} FROM L WHERE ({_KEY}, date, id) > ('1996.03.15', '1996.03.15', 'mt_5') ORDER BY {_KEY}, date, id LIMIT 20")
def page_after(spark, sf_dir):
    return _cols(pages.page_after(listings(spark, sf_dir), "1996.03.15", "mt_5"))


# --- text ------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {norm_sql('text')} AS norm FROM documents", view=False)
def normalize_title(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_title(F.col("text")).alias("norm"))


@query(f"SELECT id, {start_sql('date')} AS start_date FROM L")
def start_date(spark, sf_dir):
    return listings(spark, sf_dir).select("id", text.start_date(F.col("date")).alias("start_date"))


@query("SELECT id, CASE WHEN starts_with(id, 'mt_') OR starts_with(id, 'mtglobal_') THEN '摩天轮' ELSE '大麦' END AS label FROM L")
def source_label(spark, sf_dir):
    return listings(spark, sf_dir).select("id", text.source_label(F.col("id")).alias("label"))


@query(
    """SELECT id, CASE WHEN artist <> '' AND artist NOT IN ('Unknown', '群星') AND starts_with(title, '【' || artist || '】')
        THEN substr(title, length('【' || artist || '】') + 1) ELSE title END AS card, regexp_replace(title, '^【.*?】', '') AS short FROM L"""
)
def display_title(spark, sf_dir):
    return listings(spark, sf_dir).select("id", text.card_title(F.col("title"), F.col("artist")).alias("card"), text.short_title(F.col("title")).alias("short"))


@query(
    """SELECT id, coalesce(nullif(artist, ''), '群星') AS artist, coalesce(nullif(venue, ''), '待定') AS venue,
        CASE WHEN starts_with(id, 'mt') THEN '' ELSE 'https://detail.example/item?id=' || id END AS url FROM L"""
)
def detail_view(spark, sf_dir):
    url = F.when(F.col("id").startswith("mt"), "").otherwise(F.concat(F.lit("https://detail.example/item?id="), "id"))
    return listings(spark, sf_dir).select("id", text.or_else("artist", "群星").alias("artist"), text.or_else("venue", "待定").alias("venue"), url.alias("url"))


@query(
    """SELECT id, regexp_extract(c, '_m_h5_tk=([^;]+)', 1) AS token FROM
      (SELECT id, regexp_extract('curl -b "a=1; _m_h5_tk=abc' || CAST(ord AS VARCHAR) || '_17; x=2" http://x', '(?:-b|--cookie)\\s+[''"]([^''"]+)[''"]', 1) AS c FROM L)"""
)
def regex_extract_token(spark, sf_dir):
    body = F.concat(F.lit('curl -b "a=1; _m_h5_tk=abc'), F.col("ord").cast("string"), F.lit('_17; x=2" http://x'))
    cookie = F.regexp_extract(body, r"""(?:-b|--cookie)\s+['"]([^'"]+)['"]""", 1)
    return listings(spark, sf_dir).select("id", F.regexp_extract(cookie, "_m_h5_tk=([^;]+)", 1).alias("token"))


@query("SELECT id, md5(concat_ws('&', 'token', CAST(updated_at AS VARCHAR), '12574478', '{\"q\":\"' || city || '\"}')) AS sign FROM L")
def md5_sign(spark, sf_dir):
    body = F.concat(F.lit('{"q":"'), "city", F.lit('"}'))
    return listings(spark, sf_dir).select("id", F.md5(F.concat_ws("&", F.lit("token"), F.col("updated_at").cast("string"), F.lit("12574478"), body)).alias("sign"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", view=False)
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# --- classification ----------------------------------------------------------------------------

_TAGS = "SELECT id, CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN '热销榜' WHEN 2 THEN artist || '演出' ELSE artist END AS tag FROM L"


@query(f"SELECT id, tag, tag <> '' AND NOT ({any_sql('tag', NOISE_TAGS)}) AS valid FROM ({_TAGS})")
def tag_validity(spark, sf_dir):
    tag = F.when(F.col("ord") % 5 == 0, "").when(F.col("ord") % 5 == 1, "热销榜").when(F.col("ord") % 5 == 2, F.concat("artist", F.lit("演出"))).otherwise(F.col("artist"))
    return listings(spark, sf_dir).select("id", tag.alias("tag")).withColumn("valid", classify.valid_tag(F.col("tag")))


_TRIB = "SELECT id, ord, artist, is_tribute, CASE ord % 6 WHEN 0 THEN '致敬' || title WHEN 1 THEN title || '烛光' ELSE title END AS title FROM L"


def _tributes(spark, sf_dir):
    title = F.when(F.col("ord") % 6 == 0, F.concat(F.lit("致敬"), "title")).when(F.col("ord") % 6 == 1, F.concat("title", F.lit("烛光"))).otherwise(F.col("title"))
    return listings(spark, sf_dir).withColumn("title", title)


@query(f"SELECT id, {any_sql('title', TRIBUTE_WORDS)} AS tribute FROM ({_TRIB})")
def classify_tribute(spark, sf_dir):
    return _tributes(spark, sf_dir).select("id", classify.is_tribute(F.col("title")).alias("tribute"))


@query(
    f""", R AS (SELECT *, CASE WHEN {any_sql('title', TRIBUTE_WORDS)} THEN 'tribute' WHEN artist <> '' AND artist NOT IN ('群星', 'Unknown') AND NOT ({any_sql('artist', TRIBUTE_WORDS)}) THEN 'official' ELSE 'extract' END AS route FROM ({_TRIB}))
SELECT id, route, CASE WHEN route = 'official' AND NOT starts_with(title, '【') THEN '【' || artist || '】' || title ELSE title END AS title,
  CASE WHEN route = 'tribute' THEN 'Unknown' ELSE artist END AS artist, route = 'tribute' OR is_tribute AS is_tribute FROM R"""
)
def artist_routing(spark, sf_dir):
    return classify.route(_tributes(spark, sf_dir)).select("id", "route", "title", "artist", "is_tribute")


@query("SELECT id, CASE WHEN a IN ('歌手', '音乐会') THEN 'Unknown' ELSE a END AS artist FROM (SELECT id, CASE ord % 4 WHEN 0 THEN '歌手' WHEN 1 THEN '音乐会' ELSE artist END AS a FROM L)")
def fix_invalid_artist(spark, sf_dir):
    artist = F.when(F.col("ord") % 4 == 0, "歌手").when(F.col("ord") % 4 == 1, "音乐会").otherwise(F.col("artist"))
    return classify.fix_invalid_artists(listings(spark, sf_dir).withColumn("artist", artist)).select("id", "artist")


@query(
    """, X AS (SELECT title, CASE WHEN k % 3 = 0 THEN '' ELSE 'S' || CAST(k % 5 AS VARCHAR) END AS a, k % 4 = 0 AS t, CASE WHEN k % 2 = 0 THEN k % 6 <> 0 END AS f
  FROM (SELECT title, min(ord) AS k FROM L WHERE ord % 2 = 0 GROUP BY title)),
J AS (SELECT L.*, X.title IS NOT NULL AS hit, CASE WHEN t OR NOT coalesce(f, true) THEN 'Unknown' ELSE coalesce(nullif(a, ''), 'Unknown') END AS na, t, coalesce(f, true) AS f FROM L LEFT JOIN X ON L.title = X.title)
SELECT id, CASE WHEN hit AND na <> 'Unknown' AND NOT starts_with(title, '【') THEN '【' || na || '】' || title ELSE title END AS title,
  CASE WHEN hit THEN na ELSE artist END AS artist, CASE WHEN hit THEN t ELSE is_tribute END AS is_tribute, CASE WHEN hit THEN f ELSE is_famous END AS is_famous FROM J"""
)
def apply_extraction(spark, sf_dir):
    rows = listings(spark, sf_dir)
    k = F.col("k")
    found = rows.filter("ord % 2 = 0").groupBy("title").agg(F.min("ord").alias("k")).select("title", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("S"), (k % 5).cast("string"))).alias("artist"), (k % 4 == 0).alias("is_tribute"), F.when(k % 2 == 0, k % 6 != 0).alias("is_famous"))
    return classify.apply_extraction(rows, found).select("id", "title", "artist", "is_tribute", "is_famous")


# --- sources -------------------------------------------------------------------------------------


def _trees(spark, sf_dir):
    """Each region as trees of a thousand supplier keys at most: nation nodes (groups) with supplier nodes (listings)."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    leaf = F.struct(F.lit("7587").alias("type"), F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("name"), F.col("n_name").alias("cityName"), F.when(F.col("s_suppkey") % 4 == 0, F.lit("")).when(F.col("s_suppkey") % 4 == 1, F.lit("热销榜")).otherwise(F.lit("Star")).alias("showTag")).alias("data"))
    nations = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_regionkey", F.floor(F.col("s_suppkey") / 1000).alias("part"), "n_nationkey").agg(F.sort_array(F.collect_list(F.struct("s_suppkey", leaf.alias("leaf")))).alias("x"))
    nations = nations.select("n_regionkey", "part", "n_nationkey", F.struct(F.lit("g").alias("type"), F.transform("x", lambda x: x["leaf"]).alias("nodes")).alias("node"))
    regions = nations.groupBy("n_regionkey", "part").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", F.to_json("node").alias("node")))).alias("x"))
    body = F.concat(F.lit('{"nodes":['), F.array_join(F.transform("x", lambda x: x["node"]), ","), F.lit("]}"))
    return regions.select(F.col("n_regionkey").alias("tree_id"), body.alias("body"))


_LEAVES = "supplier JOIN nation ON s_nationkey = n_nationkey"


@query(f"SELECT CAST(n_regionkey AS INTEGER) AS tree_id, CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM {_LEAVES}", view=False)
def tree_flatten(spark, sf_dir):
    nodes = landing.listing_nodes(landing.flatten_tree(_trees(spark, sf_dir)))
    return nodes.orderBy("tree_id", "path").select(F.col("tree_id").cast("int").alias("tree_id"), F.try_variant_get("data", "$.id", "string").alias("id"), F.try_variant_get("data", "$.name", "string").alias("name"))


@query(
    f"""SELECT CAST(n_regionkey AS INTEGER) AS tree_id, true AS is_listing, CAST(s_suppkey AS VARCHAR) AS id, count(*) AS n FROM {_LEAVES} WHERE contains(s_name, '#00000001') GROUP BY ALL
UNION ALL SELECT CAST(n_regionkey AS INTEGER), false, NULL, count(DISTINCT n_nationkey) FROM {_LEAVES} WHERE contains(s_name, '#00000001') GROUP BY n_regionkey""",
    view=False,
)
def tree_keyword_scan(spark, sf_dir):
    """Listings with the word in their title, and how many groups of each tree have it anywhere below."""
    found = landing.find_keyword(landing.flatten_tree(_trees(spark, sf_dir)), "#00000001")
    return found.groupBy(F.col("tree_id").cast("int").alias("tree_id"), "is_listing", F.try_variant_get("data", "$.id", "string").alias("id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS title, n_name AS city, '' AS venue, '' AS date, 'Pending' AS price, 'Unknown' AS status, 'Concert' AS category,
      CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' ELSE 'Star' END AS artist, s_suppkey % 4 <> 1 AS is_famous FROM {_LEAVES}""",
    view=False,
)
def project_source_a(spark, sf_dir):
    nodes = landing.listing_nodes(landing.flatten_tree(_trees(spark, sf_dir)))
    return landing.project_a(nodes).drop("image")


_B_SQL = """SELECT 'mt_' || CAST(ord AS VARCHAR) AS id, title, '' AS image, date, coalesce(nullif(city, ''), 'X') AS city, venue,
      CASE WHEN ord % 9 = 0 THEN '价格待定' ELSE '￥' || price || CASE WHEN ord % 2 = 0 THEN '起' ELSE '' END END AS price,
      coalesce(nullif(status, ''), '销售中') AS status, '演唱会' AS category, CASE WHEN ord % 3 = 0 THEN artist ELSE '' END AS artist FROM L"""


def _items_b(spark, sf_dir):
    k = F.col("ord")
    tag = lambda kind, name: F.struct(F.lit(kind).alias("tagType"), name.alias("tagName"))
    return listings(spark, sf_dir).select(
        "ord", k.cast("string").alias("showId"), F.col("title").alias("showName"), F.col("date").alias("showDate"), F.col("city").alias("showCity"), F.lit("X").alias("cityName"), F.col("venue").alias("venueName"), F.col("status").alias("showStatusDisplayName"),
        F.when(k % 9 != 0, F.struct(F.lit("￥").alias("prefix"), F.col("price").alias("yuanNum"), F.when(k % 2 == 0, "起").alias("suffix"))).alias("priceInfo"),
        F.when(k % 3 == 0, F.array(tag("GENRE", F.lit("Pop")), tag("ARTIST", F.col("artist")))).alias("tags"),
    )


@query(_B_SQL)
def project_source_b(spark, sf_dir):
    return landing.project_b(_items_b(spark, sf_dir).drop("ord"))


@query(f"{_B_SQL} WHERE (ord // 10) % 4 <> 1")
def pages_source_b(spark, sf_dir):
    """Pages of ten items as landed JSON, every fourth of which failed."""
    items = _items_b(spark, sf_dir)
    page = F.struct(F.when(F.col("page") % 4 == 1, 500).otherwise(200).alias("statusCode"), F.struct(F.col("items").alias("searchData")).alias("data"))
    pages = items.groupBy(F.floor(F.col("ord") / 10).alias("page")).agg(F.collect_list(F.struct(*[c for c in items.columns if c != "ord"])).alias("items"))
    folder = scratch(spark, "pages-b")
    pages.select(F.to_json(page)).write.text(folder)
    return landing.listings_b(spark.read.schema(PAGE_B).json(folder))


_C_SQL = """SELECT 'mtglobal_' || CAST(ord AS VARCHAR) AS id, '東' || title AS old_title, '东' || title AS title, image,
      coalesce(nullif(regexp_extract(replace(split_part(date, ' - ', 1), '/', '.'), '([0-9]{4}\\.[0-9]{2}\\.[0-9]{2})', 1), ''), replace(split_part(date, ' - ', 1), '/', '.')) AS date,
      coalesce(nullif(city, ''), '台湾') AS city, venue, coalesce(nullif(price, ''), 'Pending') AS price,
      CASE WHEN status = 'O' THEN '销售中' ELSE coalesce(nullif(status, ''), 'Unknown') END AS status, '演唱会' AS category, '' AS artist, ord FROM L"""


def _items_c(spark, sf_dir):
    return listings(spark, sf_dir).select(
        "ord", F.col("ord").cast("string").alias("id"), F.concat(F.lit("東"), F.col("title")).alias("title"), F.col("venue").alias("venueName"), F.col("city").alias("location"), F.lit("臺灣").alias("locationName"), F.col("date").alias("showDate"), F.col("image").alias("imgUrl"), F.col("price").alias("salePrice"), F.when(F.col("status") == "O", "ONSALE").otherwise(F.col("status")).alias("status")
    )


@query(f"SELECT * EXCLUDE (old_title, ord) FROM ({_C_SQL})")
def project_source_c(spark, sf_dir):
    return landing.project_c(_items_c(spark, sf_dir).drop("ord"))


@query(f"SELECT * EXCLUDE (old_title, ord) REPLACE (CASE WHEN ord % 20 = 0 THEN '台湾' ELSE city END AS city) FROM ({_C_SQL}) WHERE ord % 20 <> 1")
def pages_source_c(spark, sf_dir):
    """Pages of twenty items as landed JSON; one item of each names no city, and one lies in a city that is not listed."""
    k = F.col("ord") % 20
    items = _items_c(spark, sf_dir).withColumn("location", F.when(k == 0, "").when(k == 1, "巴黎").otherwise(F.col("location")))
    pages = items.groupBy(F.floor(F.col("ord") / 20).alias("page"), "locationName").agg(F.collect_list(F.struct(*[c for c in items.columns if c not in ("ord", "locationName")])).alias("data"))
    folder = scratch(spark, "pages-c")
    pages.select(F.to_json(F.struct(F.lit(200).alias("statusCode"), "data", "locationName"))).write.text(folder)
    return landing.listings_c(spark.read.schema(PAGE_C).json(folder))


@query(f"SELECT * EXCLUDE (old_title, ord) FROM ({_C_SQL}) WHERE (ord // 20) % 25 % 5 <> 2")
def pages_of_locations(spark, sf_dir):
    """Pages of source C asked for all locations, a fifth of which belong to the mainland and are not crawled."""
    folder = scratch(spark, "locations-c")
    nation, key = table(spark, sf_dir, "nation"), F.col("n_nationkey")
    place = F.struct(key.cast("string").alias("id"), F.when(key % 5 == 2, "CN").when(key % 5 < 4, F.col("n_name")).alias("code"), F.col("n_name").alias("name"))
    nation.groupBy("n_regionkey").agg(F.collect_list(place).alias("data")).select(F.to_json(F.struct(F.lit(True).alias("success"), "data"))).write.text(f"{folder}/locations")
    items = _items_c(spark, sf_dir)
    page = F.floor(F.col("ord") / 20)
    pages = items.groupBy(page.alias("page"), (page % 25).cast("string").alias("locationId"), "locationName").agg(F.collect_list(F.struct(*[c for c in items.columns if c not in ("ord", "locationName")])).alias("data"))
    pages.select(F.to_json(F.struct(F.lit(200).alias("statusCode"), "data", "locationId", "locationName"))).write.text(f"{folder}/pages")
    places = landing.locations_c(spark.read.schema(LOCATIONS_C).json(f"{folder}/locations"))
    return landing.listings_c(spark.read.schema(PAGE_C).json(f"{folder}/pages"), locations=places)


_WORDS = """SELECT n_name AS phrase, '<' || CAST(n_nationkey AS VARCHAR) || '>' AS simplified FROM nation
  UNION ALL SELECT n_name || ' 東', 'x' FROM nation WHERE n_nationkey % 2 = 0 UNION ALL SELECT DISTINCT 'Tour ' || substr(o_orderdate::VARCHAR, 1, 3), 'T' FROM orders"""


@query(
    LISTINGS_SQL.replace("WITH L0", "WITH RECURSIVE L0", 1)
    + f""", D AS (SELECT list({{'p': phrase, 's': simplified}} ORDER BY length(phrase) DESC, phrase) AS d FROM ({_WORDS} UNION ALL SELECT * FROM (VALUES ('東', '东'), ('會', '会')))),
K AS (
  SELECT t, 1 AS pos, '' AS done FROM (SELECT DISTINCT title || ' 東會演' AS t FROM L)
  UNION ALL
  SELECT t, pos + CASE WHEN hit IS NULL THEN 1 ELSE length(hit.p) END, done || CASE WHEN hit IS NULL THEN substr(t, pos, 1) ELSE hit.s END
  FROM (SELECT t, pos, done, list_filter(d, lambda x: starts_with(substr(t, pos), x.p))[1] AS hit FROM K, D WHERE pos <= length(t)))
SELECT id, done AS title FROM L JOIN (SELECT t, done FROM K WHERE pos > length(t)) ON t = title || ' 東會演'""",
    view=False,
)
def phrase_conversion(spark, sf_dir):
    """Titles of source C by a dictionary made of names and years: longest phrases before short ones, and characters last."""
    nation, orders = table(spark, sf_dir, "nation"), table(spark, sf_dir, "orders")
    name = F.col("n_name")
    words = nation.select(name.alias("phrase"), F.concat(F.lit("<"), F.col("n_nationkey").cast("string"), F.lit(">")).alias("simplified"))
    words = words.unionByName(nation.filter("n_nationkey % 2 = 0").select(F.concat(name, F.lit(" 東")).alias("phrase"), F.lit("x").alias("simplified")))
    words = words.unionByName(orders.select(F.concat(F.lit("Tour "), F.substring(F.col("o_orderdate").cast("string"), 1, 3)).alias("phrase"), F.lit("T").alias("simplified")).distinct())
    convert = landing.phrases(words)
    return listings(spark, sf_dir).select("id", convert(F.concat("title", F.lit(" 東會演"))).alias("title"))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS \"cityId\", n_name AS \"cityName\", CASE WHEN n_nationkey < 5 THEN 'hot' ELSE 'group' END AS place FROM nation", view=False)
def nested_city_list(spark, sf_dir):
    return landing.city_list(_city_bodies(spark, sf_dir, F.col("n_name"))).select("cityId", "cityName", "place")


def _city_bodies(spark, sf_dir, name):
    """A city list with the first five nations as hot cities and the others grouped by region."""
    n = table(spark, sf_dir, "nation").withColumn("c", F.struct(F.col("n_nationkey").cast("string").alias("cityId"), name.alias("cityName"), F.lit("").alias("url")))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "c"))), lambda x: x["c"])
    regions = n.filter("n_nationkey >= 5").groupBy("n_regionkey").agg(F.struct("n_regionkey", F.struct(listed.alias("sites")).alias("g")).alias("r"))
    groups = F.transform(F.array_sort(F.collect_list("r")), lambda x: x["g"]).alias("groups")
    bodies = n.filter("n_nationkey < 5").agg(listed.alias("hotCities")).join(regions.agg(groups))
    return bodies.withColumn("hotCity", F.col("hotCities"))


_PAGES = """P AS (
  SELECT o_custkey % 40 AS city, CAST(1 + o_orderkey // 4 % 60 AS INTEGER) AS page, list(CAST(o_orderkey % 700 AS VARCHAR)) AS ids, count(*) AS n FROM orders GROUP BY ALL),
R AS (
  SELECT city, page, (city + page) % 5 > 0 AND (city * 7 + page // 4) % 6 > 0 AS ok, CASE WHEN (city + page * page) % 4 = 0 THEN [] ELSE ids END AS ids, city % 13 = 5 AND page = 3 AS cancelled, city * 9 AS total FROM P)"""


def _pages(spark, sf_dir):
    """Orders as pages of cities: some fail, some are empty, and some cities are cancelled."""
    k, city, page = F.col("o_orderkey"), F.col("city"), F.col("page")
    rows = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 40).alias("city"), (1 + F.floor(k / 4) % 60).cast("int").alias("page"), (k % 700).cast("string").alias("id"))
    pages = rows.groupBy("city", "page").agg(F.collect_list("id").alias("ids"))
    none = F.array().cast("array<string>")
    return pages.select(
        "city", "page", (((city + page) % 5 > 0) & ((city * 7 + F.floor(page / 4)) % 6 > 0)).alias("ok"), F.when((city + page * page) % 4 == 0, none).otherwise(F.col("ids")).alias("ids"), ((city % 13 == 5) & (page == 3)).alias("cancelled"), (city * 9).alias("total")
    )


@query(
    f"""WITH RECURSIVE {_PAGES},
K AS (
  SELECT city, 0 AS page, CAST([] AS VARCHAR[]) AS seen, CAST([] AS VARCHAR[]) AS ids, 0 AS empties, 0 AS failures, false AS over, false AS dead FROM R GROUP BY city
  UNION ALL
  SELECT K.city, R.page, CASE WHEN ok THEN list_distinct(K.seen || R.ids) ELSE K.seen END, CASE WHEN ok THEN list_filter(list_distinct(R.ids), lambda x: NOT list_contains(K.seen, x)) ELSE [] END,
    CASE WHEN NOT ok THEN K.empties WHEN len(R.ids) = 0 THEN K.empties + 1 ELSE 0 END, CASE WHEN ok THEN 0 ELSE K.failures + 1 END,
    CASE WHEN NOT ok THEN K.failures = 2 WHEN len(R.ids) = 0 THEN K.empties = 1 ELSE len(R.ids) < 3 OR len(list_filter(R.ids, lambda x: NOT list_contains(K.seen, x))) = 0 END, K.dead OR R.cancelled
  FROM K JOIN R ON R.city = K.city AND R.page = K.page + 1 WHERE NOT K.over AND K.page < 50)
SELECT city, page, id FROM (SELECT city, page, unnest(ids) AS id FROM K WHERE city NOT IN (SELECT city FROM K WHERE dead))""",
    view=False,
)
def paging_rules_a(spark, sf_dir):
    return paging.pages_a(_pages(spark, sf_dir), size=3)


@query(
    f"""WITH RECURSIVE {_PAGES},
K AS (
  SELECT city, 0 AS page, CAST([] AS VARCHAR[]) AS ids, false AS over FROM R GROUP BY city
  UNION ALL
  SELECT K.city, R.page, CASE WHEN ok THEN R.ids ELSE [] END, NOT ok OR len(R.ids) = 0 OR R.page * 10 >= R.total FROM K JOIN R ON R.city = K.city AND R.page = K.page + 1 WHERE NOT K.over AND K.page < 20)
SELECT city, page, unnest(ids) AS id FROM K""",
    view=False,
)
def paging_rules_total(spark, sf_dir):
    return paging.pages_total(_pages(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {_PAGES},
K AS (
  SELECT city, 0 AS page, CAST([] AS VARCHAR[]) AS ids, false AS over FROM R GROUP BY city
  UNION ALL
  SELECT K.city, R.page, CASE WHEN ok THEN R.ids ELSE [] END, NOT ok OR len(R.ids) < 3 FROM K JOIN R ON R.city = K.city AND R.page = K.page + 1 WHERE NOT K.over AND K.page < 6)
SELECT city, page, unnest(ids) AS id FROM K""",
    view=False,
)
def paging_rules_short(spark, sf_dir):
    return paging.pages_short(_pages(spark, sf_dir), size=3)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events", view=False)
def jsonp_parse(spark, sf_dir):
    body = F.concat(F.lit(" cb("), "props", F.lit(");"))
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(landing.unwrap_jsonp(body), "$.k", "long").alias("k"))


# --- merge -----------------------------------------------------------------------------------------


def _sources(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return [rows.filter(F.col("src") == k).drop("src") for k in range(3)]


def _to_merge(spark, sf_dir):
    return [x.select("id", "ord", "title", "date", "city", "artist") for x in _sources(spark, sf_dir)]


@query(PAIRS_SQL + "SELECT id_a, id_b FROM PAIRS")
def dup_pairs(spark, sf_dir):
    a, b, _ = (x.select("id", "date", "city", "artist", "title") for x in _sources(spark, sf_dir))
    return merge.duplicate_pairs(a, b).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


@query(PAIRS_SQL + "SELECT id_a, id_b FROM PAIRS")
def dup_pairs_by_text(spark, sf_dir):
    """The pairs as crowded dates find them: by artists and by grams of titles."""
    a, b, _ = (x.select("id", "date", "city", "artist", "title") for x in _sources(spark, sf_dir))
    return merge.duplicate_pairs(a, b, crowded=1).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))


@query(MERGE_SQL + "SELECT id, title, artist, side, ord, action FROM M1", view=False)
def merge_by_component(spark, sf_dir):
    """The merge as crowded dates do it."""
    a, b, _ = _to_merge(spark, sf_dir)
    return merge.merge(a, b, crowded=1).select("id", "title", "artist", "side", "ord", "action")


@query(PAIRS_SQL + "SELECT id_b AS id, arg_min(id_a, ord_a) AS match_id FROM PAIRS GROUP BY id_b")
def first_match(spark, sf_dir):
    a, b, _ = _sources(spark, sf_dir)
    return merge.first_match(a, b)


@query(PAIRS_SQL + "SELECT id, title FROM L WHERE src = 1 AND id NOT IN (SELECT id_b FROM PAIRS)")
def new_rows_anti(spark, sf_dir):
    a, b, _ = _sources(spark, sf_dir)
    return merge.new_rows(a, b).select("id", "title")


@query(
    PAIRS_SQL
    + """, B AS (SELECT id_a AS id, title_a AS t, arg_min(artist_b, ord_b) AS artist FROM PAIRS WHERE artist_a = '' AND artist_b NOT IN ('', 'Unknown', '群星', '待定', '歌手', '音乐会') GROUP BY id_a, title_a)
SELECT id, artist, CASE WHEN contains(t, artist) THEN t ELSE '【' || artist || '】' || regexp_replace(t, '^【.*?】', '') END AS title FROM B"""
)
def enrich_artist(spark, sf_dir):
    a, b, _ = _sources(spark, sf_dir)
    return merge.enrich_artist(a, b)


@query(MERGE_SQL + "SELECT id, title, artist, side, ord, action FROM M1", view=False)
def merge_full(spark, sf_dir):
    a, b, _ = _to_merge(spark, sf_dir)
    return merge.merge(a, b).select("id", "title", "artist", "side", "ord", "action")


@query(MERGE_ALL_SQL + "SELECT id, title, artist, side, ord, action FROM M3", view=False)
def merge_sources(spark, sf_dir):
    a, b, c = _to_merge(spark, sf_dir)
    return merge.merge_all(a.filter("ord % 4 < 2"), [a, b, c]).select("id", "title", "artist", "side", "ord", "action")


@query(
    MERGE_SQL
    + """SELECT count(*) FILTER (WHERE starts_with(action, 'new')) AS n_new, count(*) FILTER (WHERE ends_with(action, '+enriched')) AS n_enriched,
      count(*) AS total_combined, count(*) - count(*) FILTER (WHERE side = 0) AS total_new FROM M1""",
    view=False,
)
def merge_summary(spark, sf_dir):
    a, b, _ = _to_merge(spark, sf_dir)
    return merge.summary(merge.merge(a, b))


# --- calendar --------------------------------------------------------------------------------------


def _events(spark, sf_dir):
    return calendar.events(listings(spark, sf_dir), AS_OF)


@query(EVENTS_SQL + "SELECT id, title, strftime(start, '%Y-%m-%d %H:%M') AS start, strftime(start + to_minutes(180), '%Y-%m-%d %H:%M') AS \"end\", false AS all_day, is_fallback FROM E")
def events_transform(spark, sf_dir):
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)
    return _events(spark, sf_dir).select("id", "title", shown("start"), shown("end"), "all_day", "is_fallback")


@query(EVENTS_SQL + f"SELECT id, title FROM E WHERE CAST(start AS DATE) = DATE '{WEEK_OF}'")
def events_on_day(spark, sf_dir):
    return _events(spark, sf_dir).filter(F.to_date("start") == F.lit(WEEK_OF).cast("date")).select("id", "title")


@query(EVENTS_SQL + "SELECT DISTINCT strftime(start, '%Y-%m-%d') AS day FROM E")
def distinct_event_dates(spark, sf_dir):
    return calendar.days_with_events(_events(spark, sf_dir)).select(F.date_format("day", "yyyy-MM-dd").alias("day"))


_WEEK = f"(SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '1996-03-04', TIMESTAMP '1996-03-11', INTERVAL 1 DAY))"


@query(EVENTS_SQL + f"SELECT DISTINCT CAST(hour(start) AS INTEGER) AS hour FROM E WHERE CAST(start AS DATE) IN (SELECT day FROM {_WEEK})")
def week_active_hours(spark, sf_dir):
    return calendar.active_hours(_events(spark, sf_dir), calendar.week(spark, WEEK_OF))


@query(
    EVENTS_SQL
    + f""", W AS (SELECT * FROM {_WEEK}), H AS (SELECT DISTINCT CAST(hour(start) AS INTEGER) AS hour FROM E WHERE CAST(start AS DATE) IN (SELECT day FROM W)),
C AS (SELECT CAST(start AS DATE) AS day, CAST(hour(start) AS INTEGER) AS hour, count(*) AS n FROM E GROUP BY ALL)
SELECT strftime(W.day, '%Y-%m-%d') AS day, H.hour, coalesce(n, 0) AS n FROM W CROSS JOIN H LEFT JOIN C ON C.day = W.day AND C.hour = H.hour"""
)
def calendar_grid(spark, sf_dir):
    return calendar.grid(_events(spark, sf_dir), calendar.week(spark, WEEK_OF)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_MONTH = "(SELECT CAST(range AS DATE) AS day FROM range(TIMESTAMP '1996-02-26', TIMESTAMP '1996-04-01', INTERVAL 1 DAY))"


@query(
    """SELECT strftime(m, '%Y-%m') AS month, strftime(day, '%Y-%m-%d') AS day, date_trunc('month', day) <> m AS off_range
      FROM (SELECT m, unnest(range(date_trunc('week', m), date_trunc('week', last_day(m)) + INTERVAL 7 DAY, INTERVAL 1 DAY)) AS day
        FROM (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m FROM orders))""",
    view=False,
)
def month_grid(spark, sf_dir):
    """The grids of all months in which there are orders."""
    grids = calendar.month_grids(table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")))
    return grids.select(F.date_format("month", "yyyy-MM").alias("month"), F.date_format("day", "yyyy-MM-dd").alias("day"), "off_range")


@query(EVENTS_SQL + f"SELECT strftime(m.day, '%Y-%m-%d') AS day, m.day IN (SELECT CAST(start AS DATE) FROM E) AS has_event FROM {_MONTH} m")
def day_has_event(spark, sf_dir):
    return calendar.day_flags(calendar.month_grid(spark, WEEK_OF).select("day"), _events(spark, sf_dir)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(EVENTS_SQL + "SELECT CAST(m AS INTEGER) AS month, m IN (SELECT month(start) FROM E WHERE year(start) = 1996) AS has_event FROM range(1, 13) t(m)")
def month_has_event(spark, sf_dir):
    return calendar.month_flags(spark, _events(spark, sf_dir), 1996)


#: The days of orders, moved to 2026.
_YEAR = "(SELECT DISTINCT CAST(o_orderdate + to_months(CAST(12 * (2026 - year(o_orderdate)) AS INTEGER)) AS DATE) AS day FROM orders)"


def _special_sql() -> str:
    from marquee.schema import HOLIDAYS

    rows = ", ".join(f"('{a}', '{b}', '{c}', '{d}')" for a, b, c, d in HOLIDAYS)
    return f"SELECT y.day, h.type, h.name FROM {_YEAR} y LEFT JOIN (VALUES {rows}) h(a, b, type, name) ON y.day BETWEEN CAST(a AS DATE) AND CAST(b AS DATE)"


def _year(spark, sf_dir):
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(F.add_months(day, 12 * (2026 - F.year(day))).alias("day")).distinct()


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(type, CASE WHEN dayofweek(day) IN (0, 6) THEN 'holiday' ELSE 'workday' END) AS type, name, type IS NOT NULL AS is_special FROM ({_special_sql()})", view=False)
def holiday_status(spark, sf_dir):
    return calendar.day_status(_year(spark, sf_dir), calendar.holidays(spark)).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(f"SELECT strftime(day, '%Y-%m-%d') AS day, type, coalesce(name, '') AS name FROM ({_special_sql()}) WHERE type IS NOT NULL", view=False)
def holiday_info(spark, sf_dir):
    return calendar.day_status(_year(spark, sf_dir), calendar.holidays(spark)).filter("is_special").select(F.date_format("day", "yyyy-MM-dd").alias("day"), "type", F.coalesce("name", F.lit("")).alias("name"))


@query(f"SELECT strftime(w, '%Y-%m-%d') AS week, strftime(w + to_days(CAST(i AS INTEGER)), '%Y-%m-%d') AS day FROM (SELECT DISTINCT date_trunc('week', day) AS w FROM {_YEAR}), range(7) t(i)", view=False)
def week_days(spark, sf_dir):
    return calendar.weeks(_year(spark, sf_dir)).select(F.date_format("week", "yyyy-MM-dd").alias("week"), F.date_format("day", "yyyy-MM-dd").alias("day"))


@query(
    f"""SELECT strftime(day, '%Y-%m-%d') AS day, year(day) || '年' || month(day) || '月' || day(day) || '日 ' || {list_sql(WEEKDAYS)}[dayofweek(day) + 1] AS label,
      strftime(day, '%Y年%m月%d日') AS padded, strftime(day, '%Y-%m') AS month FROM {_YEAR}""",
    view=False,
)
def date_labels(spark, sf_dir):
    return _year(spark, sf_dir).select(F.date_format("day", "yyyy-MM-dd").alias("day"), dates.long_label(F.col("day")).alias("label"), F.date_format("day", "yyyy年MM月dd日").alias("padded"), F.date_format("day", "yyyy-MM").alias("month"))


_f = lambda e, n: f"strftime({e}, '%Y-%m-%d') AS {n}"


@query(
    "SELECT " + ", ".join([_f("day", "day"), _f("day + INTERVAL 1 MONTH", "next_month"), _f("day - INTERVAL 1 MONTH", "prev_month"), _f("day + 7", "next_week"), _f("day - 7", "prev_week"), _f("day + 1", "next_day"), _f("day - 1", "prev_day"), _f("make_date(2026, 2, 1) + (day(day) - 1)::INTEGER", "month_set")]) + f" FROM {_YEAR}",
    view=False,
)
def calendar_nav(spark, sf_dir):
    moved = calendar.navigation(_year(spark, sf_dir).withColumn("month_index", F.lit(1)))
    return moved.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in moved.columns])


# --- control ---------------------------------------------------------------------------------------

_JOBS = "SELECT o_orderkey, CASE o_orderstatus WHEN 'O' THEN 'running' WHEN 'F' THEN 'completed' ELSE 'error' END AS status, CAST(floor(o_totalprice) AS BIGINT) * CASE WHEN o_orderstatus = 'O' THEN 3 ELSE 100 END AS age_ms FROM orders"


@query(
    f"""SELECT o_orderkey, status, age_ms, CASE WHEN status = 'running' AND age_ms <= 300000 THEN 'conflict' WHEN status = 'completed' AND age_ms < 14400000 THEN 'skip' ELSE 'run' END AS decision,
      CAST(CASE WHEN status = 'completed' AND age_ms < 14400000 THEN ceil((14400000 - age_ms) / 60000.0) ELSE 0 END AS BIGINT) AS minutes_left FROM ({_JOBS})""",
    view=False,
)
def sync_gate(spark, sf_dir):
    """Orders as runs of a job: open ones run, filled ones are completed, and the price tells how long since."""
    running, done = F.col("o_orderstatus") == "O", F.col("o_orderstatus") == "F"
    age = F.floor("o_totalprice").cast("long") * F.when(running, 3).otherwise(100)
    return control.gate(table(spark, sf_dir, "orders").select("o_orderkey", F.when(running, "running").when(done, "completed").otherwise("error").alias("status"), age.alias("age_ms")))


@query("SELECT ord, CAST(floor((ord % 101) * 0.55::DOUBLE + (ord % 71) * 0.25::DOUBLE + (ord % 51) * 0.2::DOUBLE) AS BIGINT) AS total, CAST(floor((ord % 101) * 0.9::DOUBLE) AS BIGINT) AS rescaled FROM L")
def weighted_progress(spark, sf_dir):
    k = F.col("ord")
    return listings(spark, sf_dir).select("ord", control.progress(k % 101, k % 71, k % 51).alias("total"), F.floor((k % 101) * 0.9).cast("long").alias("rescaled"))


@query("SELECT l_orderkey, l_linenumber, CAST(least(2000 * 2 ** (l_linenumber % 7), 16000) AS BIGINT) AS a, CAST(least(800 * 2 ** (l_linenumber % 7), 6000) AS BIGINT) AS bc FROM lineitem", view=False)
def backoff_schedule(spark, sf_dir):
    """The waits before the attempts of each order, of which a line is one."""
    n = F.col("l_linenumber") % 7
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", control.backoff(n, "a").alias("a"), control.backoff(n, "bc").alias("bc"))


@query("SELECT user_id, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) / 5.0) AS BIGINT) AS batch FROM events", view=False)
def batch_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_id", control.batch_id(Window.partitionBy("user_id").orderBy("event_id"), 5).alias("batch"))


@query(
    """, S AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'error' END AS status FROM events)
SELECT user_id, event_id, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM S) WHERE before IS NOT NULL AND before <> status"""
)
def status_transitions(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "idle").when(F.col("event_type") == "click", "running").when(F.col("event_type") == "purchase", "completed").otherwise("error")
    log = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("seq"), F.col("ts").alias("at"), status.alias("status"))
    return control.transitions(log, "user_id").select("user_id", F.col("seq").alias("event_id"), "before", "status")


@query(
    """SELECT '超时: ' || string_agg(n_name, '、' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 0) || ' | 失败: ' || string_agg(n_name, '、' ORDER BY n_nationkey) FILTER (WHERE n_nationkey % 3 = 1) AS message
      FROM nation""",
    view=False,
)
def source_outcomes(spark, sf_dir):
    """Nations as sources, of which one in three timed out and one failed."""
    k = F.col("n_nationkey") % 3
    error = F.when(k == 0, F.concat("n_name", F.lit(" task timed out"))).when(k == 1, "HTTP 500")
    return control.outcomes(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("name"), error.alias("error")))


@query("SELECT event_type AS key, arg_max(value, event_id) AS value FROM events GROUP BY event_type", view=False)
def map_merge_last_wins(spark, sf_dir):
    """Maps of batches merged so that the last batch wins, as rows: one aggregate instead of a growing map."""
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("key")).agg(F.max_by("value", "event_id").alias("value"))


# --- streaming -------------------------------------------------------------------------------------


def _by_uploads(rows, folder: str, files: int, run) -> None:
    """Runs a stream over uploads that come one after the other, each in as many files as its rows are dealt to."""
    held = rows.withColumnRenamed("updated_at", "updatedAt")
    size = rows.agg(F.max("ord")).first()[0] // files + 1
    for k in range(files):
        held.filter(F.floor(F.col("ord") / size) == k).write.mode("append").json(folder)
        run()


@query("SELECT id, title, city, coalesce(nullif(status, ''), 'Unknown') AS status FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS r FROM (SELECT 'u' || CAST(ord % 300 AS VARCHAR) AS id, ord, title, city, status FROM L)) WHERE r = 1")
def stream_upsert_equals_batch(spark, sf_dir):
    """The table after four uploads, each a micro-batch of its own, which equals one keep-last upsert of all rows."""
    folder = scratch(spark, "uploads")
    rows = listings(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), (F.col("ord") % 300).cast("string"))).drop("src")
    catalogue = store.Catalogue(spark, f"{folder}/table")
    _by_uploads(rows, f"{folder}/in", 4, lambda: upsert_stream(uploads(spark, f"{folder}/in"), catalogue, f"{folder}/progress").awaitTermination())
    return catalogue.read().select("id", "title", "city", "status")


@query(
    """, U AS (SELECT ord // (SELECT max(ord) // 4 + 1 FROM L) AS batch, 'u' || CAST(ord % 3000 AS VARCHAR) AS id, ord % 50 = 7 AS bad FROM L),
F AS (SELECT id, min(batch) AS batch FROM U WHERE NOT bad GROUP BY id),
T AS (SELECT batch, count(*) AS received, count(*) FILTER (WHERE bad) AS refused, (SELECT count(*) FROM F WHERE F.batch <= U.batch) AS total, (SELECT count(*) FROM F WHERE F.batch = U.batch) AS total_new FROM U GROUP BY batch)
SELECT batch, true AS success, 'upsert' AS mode, received, refused, total, total_new, 'Saved ' || CAST(total AS VARCHAR) || ' listings (upsert mode)' AS message FROM T"""
)
def upload_reports(spark, sf_dir):
    """What four uploads report: received and refused rows, and the rows of the table after each."""
    folder = scratch(spark, "reports")
    rows = listings(spark, sf_dir).withColumn("id", F.concat(F.lit("u"), (F.col("ord") % 3000).cast("string"))).drop("src")
    rows = rows.withColumn("title", F.when(F.col("ord") % 50 == 7, "").otherwise(F.col("title")))
    catalogue = store.Catalogue(spark, f"{folder}/table")
    _by_uploads(rows, f"{folder}/in", 4, lambda: upsert_stream(uploads(spark, f"{folder}/in"), catalogue, f"{folder}/progress", reports=f"{folder}/reports").awaitTermination())
    return read_reports(spark, f"{folder}/reports")


@query(UPLOADS_SQL + "SELECT id, title, artist FROM M2", view=False)
def stream_merge(spark, sf_dir):
    """Two uploads, each a micro-batch of its own, merged into a table that holds the first source."""
    a, b, c = _sources(spark, sf_dir)
    folder = scratch(spark, "merges")
    catalogue = store.Catalogue(spark, f"{folder}/table")
    catalogue.upsert(a)
    for rows in (b, c):
        _by_uploads(rows, f"{folder}/in", 1, lambda: upsert_stream(uploads(spark, f"{folder}/in"), catalogue, f"{folder}/progress", smart=True).awaitTermination())
    return catalogue.read().select("id", "title", "artist")


@query("SELECT id, CASE WHEN ord % 100 = 0 THEN title || ' (moved)' ELSE title END AS title, coalesce(nullif(status, ''), 'Unknown') AS status FROM L")
def upsert_in_buckets(spark, sf_dir):
    """One id in a hundred is upserted into a stored table; only the buckets of those are read and written."""
    rows = listings(spark, sf_dir).drop("src")
    catalogue = store.Catalogue(spark, scratch(spark, "buckets"), buckets=64)
    catalogue.upsert(rows)
    catalogue.upsert(rows.filter("ord % 100 = 0").withColumn("title", F.concat("title", F.lit(" (moved)"))))
    return catalogue.read().select("id", "title", "status")


_STATUS_SQL = "CASE event_type WHEN 'view' THEN 'idle' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'completed' ELSE 'error' END"


def _by_arrivals(spark, sf_dir, folder: str, files: int, run) -> None:
    """Runs a stream over events that come by time in parts one after the other, each in as many files as the table is read in."""
    rows = table(spark, sf_dir, "events")
    low, high = rows.agg(F.min("ts"), F.max("ts")).first()
    for k in range(files):
        a, b = low + (high - low) * k / files, low + (high - low) * (k + 1) / files
        part = rows.filter((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) | F.lit(k == files - 1)))
        part.write.mode("append").parquet(folder)
        run()


@query(f"SELECT user_id, event_id, before, status FROM (SELECT *, lag(status) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT event_id, user_id, ts, {_STATUS_SQL} AS status FROM events)) WHERE before IS NOT NULL AND before <> status", view=False)
def stream_transitions(spark, sf_dir):
    """The transitions of each user as events arrive, in three micro-batches."""
    folder = scratch(spark, "transitions")

    def run():
        events = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{folder}/in")
        log = events.select("user_id", F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(_STATUS_SQL).alias("status"))
        changes = transition_stream(log, "user_id")
        changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()

    _by_arrivals(spark, sf_dir, f"{folder}/in", 3, run)
    return spark.read.parquet(f"{folder}/out").select("user_id", F.col("seq").alias("event_id"), "before", "status")


@query("SELECT DISTINCT user_id, event_type FROM events", view=False)
def stream_first_seen(spark, sf_dir):
    """Each user's kinds of events once, as they arrive in three micro-batches."""
    folder = scratch(spark, "first-seen")

    def run():
        source = spark.readStream.schema(table(spark, sf_dir, "events").schema).parquet(f"{folder}/in")
        source = source.select("user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
        seen = first_seen(source, ["user_id", "event_type"], "at", "3650 days").select("user_id", "event_type")
        seen.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()

    _by_arrivals(spark, sf_dir, f"{folder}/in", 3, run)
    return spark.read.parquet(f"{folder}/out")
