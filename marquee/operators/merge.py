"""Fuzzy matching and the ordered merge of listings.

Every match needs equal, non-empty start dates, so the start date is an exact join key;
city and title conditions stay as residual predicates.  What is compared are kinds: rows of one start date, city, artist
and title match alike, so rows that repeat these cost one comparison.  On a date with very many kinds (``CROWDED``) the
pairs come from an index of grams (``containment``) or from equal artists instead of from all pairs.

The merge itself depends on the order of rows and on its own enrichments, so it runs as a scan of
rows in order, of which only the compared columns become Python values.  A row looks for its match among kinds of kept rows, and
the steps of several sources are taken in one scan.  What is scanned together is
a start date, and on a crowded date a component: rows that can never match, whatever the merge makes of them, need
not see each other.
"""

from __future__ import annotations

import collections
import functools
import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from marquee.folders import checkpointed
from marquee.functions.text import BLANK_RANGES, NOISE_WORDS, has, normalize_title, start_date
from marquee.operators.components import components
from marquee.operators.containment import contained
from marquee.schema import EMPTY_ARTISTS

#: Kinds of one start date from which on its pairs and its merge go by texts instead of by the date.
CROWDED = 2_000
#: Up to so many crowded dates are broadcast to find their rows.
BROADCAST_DAYS = 100_000


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def is_duplicate(a: str = "a", b: str = "b") -> Column:
    """Of two kinds with equal start dates.  Titles of one code point are too short to be compared normalised."""
    x, y = (lambda c: F.col(f"{a}.{c}")), (lambda c: F.col(f"{b}.{c}"))
    short = (F.length(x("norm_title")) < 2) | (F.length(y("norm_title")) < 2)
    titles = F.when(short, _within(x("title"), y("title"))).otherwise(_within(x("norm_title"), y("norm_title")))
    artists = F.when(has(x("artist")) & has(y("artist")), x("artist") == y("artist")).otherwise(titles)
    return _within(F.coalesce(x("city"), F.lit("")), F.coalesce(y("city"), F.lit(""))) & artists


#: What the predicate looks at.  Rows that agree in these match alike, so they are compared once, as a kind.
KIND = ("start_date", "city", "artist", "title")
#: Rows of a kind that are held together at most, where its rows are listed.
HELD = 1_000


def _kind(of: str = "") -> dict[str, Column]:
    blank = lambda c: F.coalesce(F.col(of + c), F.lit(""))
    return {"start_date": start_date(F.col(f"{of}date")), "city": blank("city"), "artist": blank("artist"), "title": F.col(f"{of}title")}


def _kinds(rows: DataFrame, aggregates: list[Column], *more: str) -> DataFrame:
    """The kinds of the dated rows, with aggregates of their rows."""
    kinds = rows.withColumns(_kind()).filter("start_date <> ''").groupBy(*KIND, *more).agg(*aggregates)
    return checkpointed(kinds.withColumn("norm_title", normalize_title(F.col("title"))))


def _coarser(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kinds with ``like``, what is looked at of their title: the normalised one, but on dates with one too short to be normalised the raw one."""
    days = checkpointed(a.filter(_short()).select("start_date").unionByName(b.filter(_short()).select("start_date")).distinct())
    if days.isEmpty():
        return a.withColumn("like", F.col("norm_title")), b.withColumn("like", F.col("norm_title"))
    days = days.withColumn("raw", F.lit(True))
    each = [x.join(days, "start_date", "left").withColumn("like", F.when(F.col("raw"), F.col("title")).otherwise(F.col("norm_title"))).drop("raw") for x in (a, b)]
    return each[0], each[1]


def _merged(kinds: DataFrame, *aggregates: Column) -> DataFrame:
    """Kinds whose titles are looked at alike as one."""
    return kinds.groupBy("start_date", "city", "artist", F.col("like").alias("title"), "norm_title").agg(*aggregates)


def _of_kind(rows: DataFrame, kinds: DataFrame, how: str = "inner") -> DataFrame:
    """Rows (r) joined to their kinds (k)."""
    on = [x.eqNullSafe(F.col(f"k.{c}")) if c == "title" else x == F.col(f"k.{c}") for c, x in _kind("r.").items()]
    return rows.alias("r").join(kinds.alias("k"), on, how)


def _told(kinds: DataFrame, found: DataFrame) -> DataFrame:
    """Kinds with what was found of those that their titles were merged to."""
    on = [kinds[c] == F.col(f"f.{c}") for c in ("start_date", "city", "artist")]
    return kinds.join(found.alias("f"), [*on, kinds["like"].eqNullSafe(F.col("f.title"))]).select(*[kinds[c] for c in KIND], *[F.col(f"f.{c}") for c in found.columns if c not in KIND])


def duplicate_pairs(primary: DataFrame, secondary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """a (primary) and b (secondary) rows that are the same event, as structs.

    Kinds are compared, and carry their rows in lists of HELD or so; so give no column that is not needed.
    """

    def listed(rows: DataFrame) -> DataFrame:
        rows = rows.select("date", "city", "artist", "title", F.struct("*").alias("row"))
        large = checkpointed(rows.withColumns(_kind()).filter("start_date <> ''").groupBy(*KIND).count().filter(F.col("count") > HELD))
        part = F.lit(0)
        if not large.isEmpty():
            rows = _of_kind(rows, large, "left").select("r.*", F.col("k.count").alias("count"))
            part = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("count") / HELD)), F.lit(0))
        return _kinds(rows.withColumn("part", part), [F.collect_list("row").alias("rows")], "part")

    found = _pairs(*(x.drop("part") for x in (listed(primary), listed(secondary))), crowded)
    return found.select(F.explode("a.rows").alias("a"), F.col("b.rows").alias("rows")).select("a", F.explode("rows").alias("b"))


def _pairs(a: DataFrame, b: DataFrame, crowded: int) -> DataFrame:
    """Aliased a and b kinds that match."""
    days = _crowded(a.select("start_date").unionByName(b.select("start_date")), crowded)
    if days is None:
        return _pairs_by_day(a, b)
    few = _pairs_by_day(a.join(days, "start_date", "left_anti"), b.join(days, "start_date", "left_anti"))
    many = _pairs_by_text(a.join(days, "start_date", "left_semi"), b.join(days, "start_date", "left_semi"))
    # A union has no aliases, so both sides pass through it as structs.
    packed = [x.select(F.struct("a.*").alias("a"), F.struct("b.*").alias("b")) for x in (few, many)]
    return packed[0].unionByName(packed[1])


def _crowded(days: DataFrame, least: int) -> DataFrame | None:
    """The start dates (start_date) of so many rows; None if there are none.  At most rows / least dates are."""
    found = days.groupBy("start_date").count().filter(F.col("count") >= least).select("start_date")
    found = checkpointed(found)
    return None if found.isEmpty() else found


def _pairs_by_day(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.alias("a").join(b.alias("b"), (F.col("a.start_date") == F.col("b.start_date")) & is_duplicate())


def _short() -> Column:
    return F.length("norm_title") < 2


def _pairs_by_text(a: DataFrame, b: DataFrame) -> DataFrame:
    """The same pairs by equal artists or, where one has no artist, by texts that contain each other.

    Normalised titles meet normalised ones; raw titles meet raw ones of dates with a title too short to be normalised.
    """
    same_artist = F.col("a.artist") == F.col("b.artist")
    same_day = F.col("a.start_date") == F.col("b.start_date")
    by_artist = a.filter(has("artist")).alias("a").join(b.filter(has("artist")).alias("b"), same_day & same_artist & is_duplicate())
    raw_days = a.filter(_short()).select("start_date").unionByName(b.filter(_short()).select("start_date")).distinct()

    def texts_of(rows: DataFrame) -> DataFrame:
        plain = rows.filter(~_short()).withColumns({"kind": F.lit("plain"), "text": F.col("norm_title")})
        raw = rows.join(raw_days, "start_date", "left_semi").withColumns({"kind": F.lit("raw"), "text": F.col("title")})
        return plain.unionByName(raw)

    x, y = texts_of(a), texts_of(b)
    found = contained(*[x.select("start_date", "kind", "text").unionByName(y.select("start_date", "kind", "text"))] * 2, ["start_date", "kind"])
    either = found.select("start_date", "kind", F.col("needle").alias("ta"), F.col("hay").alias("tb")).unionByName(found.filter("needle <> hay").select("start_date", "kind", F.col("hay").alias("ta"), F.col("needle").alias("tb")))
    kind = F.when((F.length("a.norm_title") < 2) | (F.length("b.norm_title") < 2), "raw").otherwise("plain")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        near = x.alias("a").join(either.alias("t"), (F.col("a.start_date") == F.col("t.start_date")) & (F.col("a.kind") == F.col("t.kind")) & (F.col("a.text") == F.col("t.ta")))
        on = (F.col("t.start_date") == F.col("b.start_date")) & (F.col("t.kind") == F.col("b.kind")) & (F.col("t.tb") == F.col("b.text"))
        return near.join(y.alias("b"), on & (F.col("t.kind") == kind) & is_duplicate())

    bare, with_artist = ~has("artist"), has("artist")
    parts = [by_artist, meet(x.filter(bare), y), meet(x.filter(with_artist), y.filter(bare))]
    columns = lambda side, rows: F.struct(*[F.col(f"{side}.{c}").alias(c) for c in rows.columns]).alias(side)
    out = [p.select(columns("a", a), columns("b", b)) for p in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


def first_match(primary: DataFrame, secondary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Of each secondary row the first primary row that it matches: id, match_id."""
    a, b = _coarser(_kinds(primary, [F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord")]), _kinds(secondary, [F.count(F.lit(1)).alias("n")]))
    pairs = _pairs(_merged(a, F.min_by("id", "ord").alias("id"), F.min("ord").alias("ord")), _merged(b, F.sum("n").alias("n")), crowded)
    found = pairs.groupBy(*[F.col(f"b.{c}").alias(c) for c in KIND]).agg(F.min_by("a.id", "a.ord").alias("match_id"), F.min("a.ord").alias("match_ord"))
    return _of_kind(secondary, _told(b, found)).groupBy(F.col("r.id").alias("id")).agg(F.min_by("k.match_id", "k.match_ord").alias("match_id"))


def new_rows(primary: DataFrame, secondary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Secondary rows that match no primary row."""
    a, b = _coarser(*(_kinds(x, [F.count(F.lit(1)).alias("n")]) for x in (primary, secondary)))
    hit = _pairs(_merged(a, F.sum("n").alias("n")), _merged(b, F.sum("n").alias("n")), crowded).select(*[F.col(f"b.{c}").alias(c) for c in KIND]).distinct()
    return _of_kind(secondary, _told(b, hit), "left_anti")


def named(artist: Column) -> Column:
    return has(artist) & ~artist.isin(*EMPTY_ARTISTS)


def enriched_title(title: Column, artist: Column) -> Column:
    bare = F.regexp_replace(title, "^【.*?】", "")
    return F.when(F.contains(title, artist), title).otherwise(F.concat(F.lit("【"), artist, F.lit("】"), bare))


def enrich_artist(primary: DataFrame, secondary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Primary rows without an artist, with that of the first named row that matches: id, artist, title."""
    bare, first = primary.filter(~has("artist")), [F.min("ord").alias("ord")]
    a, b = _coarser(_kinds(bare, [F.count(F.lit(1)).alias("n")]), _kinds(secondary.filter(named(F.col("artist"))), first))
    pairs = _pairs(_merged(a, F.sum("n").alias("n")), _merged(b, *first), crowded)
    found = pairs.groupBy(*[F.col(f"a.{c}").alias(c) for c in KIND]).agg(F.min_by("b.artist", "b.ord").alias("named"), F.min("b.ord").alias("ord"))
    best = _of_kind(bare, _told(a, found)).groupBy(F.col("r.id").alias("id"), F.col("r.title").alias("title")).agg(F.min_by("k.named", "k.ord").alias("artist"))
    return best.select("id", "artist", enriched_title(F.col("title"), F.col("artist")).alias("title"))


_BLANKS = re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in BLANK_RANGES) + "]+")
_WORDS = re.compile(NOISE_WORDS)


@functools.lru_cache(100_000)
def plain_title(title: str) -> str:
    """normalize_title for the scan, where titles change on the way."""
    out = _BLANKS.sub("", title.lower())
    for opening, closing in ("【】", "[]", "()"):
        out = re.sub(f"{re.escape(opening)}.*?{re.escape(closing)}", "", out)
    return _WORDS.sub("", re.sub(r"[0-9]{4}", "", out))


def _alike(a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Of two texts (normalised title, title).  Titles of one code point are too short to be compared normalised."""
    k = 1 if min(len(a[0]), len(b[0])) < 2 else 0
    return a[k] in b[k] or b[k] in a[k]


class _Kept:
    """Kept rows by what the predicate looks at, so that a row finds the first that it matches without a look at each.

    Rows with an artist never change: the first of each artist and city, and of each text and city, is all that can be found.
    Those without queue by text and city; the first of a queue leaves it as it gets an artist.
    """

    def __init__(self):
        self.by_artist: dict = collections.defaultdict(dict)
        self.named: dict = collections.defaultdict(dict)
        self.bare: dict = collections.defaultdict(dict)
        self.texts: dict = {}
        self.order: list = []
        self.seen: dict = {}

    def add(self, at: int, city: str, artist: str, text: tuple | None) -> None:
        if text is not None and text not in self.texts:
            self.texts[text] = None
            self.order.append(text)
        if not artist:
            self.bare[text].setdefault(city, collections.deque()).append(at)
            return
        for first in (self.by_artist[artist], self.named[text]):
            if first.get(city, at) >= at:
                first[city] = at

    def name(self, at: int, city: str, artist: str, text: tuple, new: tuple) -> None:
        """The row at the front of its queue gets an artist, and with it a title."""
        queue = self.bare[text][city]
        assert queue.popleft() == at
        if not queue:
            del self.bare[text][city]
        self.add(at, city, artist, new)

    def _texts_like(self, text: tuple) -> list:
        upto, found = self.seen.get(text, (0, []))
        if upto < len(self.order):
            found.extend(t for t in self.order[upto:] if _alike(text, t))
            self.seen[text] = (len(self.order), found)
        return found

    def first(self, city: str, artist: str, text: tuple | None) -> int | None:
        best = None
        if artist and artist in self.by_artist:
            for c, at in self.by_artist[artist].items():
                if (best is None or at < best) and (c in city or city in c):
                    best = at
        for like in self._texts_like(text) if text is not None else ():
            if like in self.bare:
                for c, queue in self.bare[like].items():
                    if (best is None or queue[0] < best) and (c in city or city in c):
                        best = queue[0]
            if not artist and like in self.named:
                for c, at in self.named[like].items():
                    if (best is None or at < best) and (c in city or city in c):
                        best = at
        return best


class _Scan:
    """The rows of one scan: their compared values, which change in the merge."""

    def __init__(self, cities: list, artists: list, titles: list):
        self.city, self.artist, self.title = ([x or "" for x in cities], [x or "" for x in artists], titles)
        # A normalised title stays as a row gets an artist, but for artists with a closing bracket; so it stands for the title unless titles are compared raw.
        plains = [plain_title(t) for t in set(titles) if t is not None]
        self.raw = any(len(p) < 2 for p in plains) or any("】" in a for a in set(self.artist))
        self.text = [self._text(t) for t in titles]

    def _text(self, title: str | None) -> tuple | None:
        return None if title is None else (plain_title(title), title if self.raw else "")

    def merge(self, primary: list[int], secondary: list[int]) -> tuple[list[int], set[int]]:
        """The rows that stay, in order, and those that took an artist from one that does not."""
        kept, stay, changed = _Kept(), [], set()
        for row in primary:
            kept.add(len(stay), self.city[row], self.artist[row], self.text[row])
            stay.append(row)
        for row in secondary:
            city, artist, text = self.city[row], self.artist[row], self.text[row]
            at = kept.first(city, artist, text)
            if at is None:
                kept.add(len(stay), city, artist, text)
                stay.append(row)
                continue
            match = stay[at]
            # One that has an artist, even one that says nothing, is matched by rows of that artist or of none.
            if artist and artist not in EMPTY_ARTISTS and not self.artist[match]:
                before = self.text[match]
                if artist not in self.title[match]:
                    self.title[match] = f"【{artist}】" + re.sub("^【.*?】", "", self.title[match])
                    self.text[match] = self._text(self.title[match])
                self.artist[match] = artist
                changed.add(match)
                kept.name(at, self.city[match], artist, before, self.text[match])
        return stay, changed


def _decided(rows: pa.Table) -> pa.Table:
    """Whole scans, in order of ``scan``, ``place`` and ``ord``: the rows that stay, as they are then.

    Lists from the second on (``place``) are merged into the first of them; what stays is merged into the existing list (place 0).
    """
    scans, places, cities, artists, titles = (rows.column(c).to_pylist() for c in ("scan", "place", "city", "artist", "title"))
    stays, actions, first = [], [], 0
    for end in range(1, len(scans) + 1):
        if end < len(scans) and scans[end] == scans[first]:
            continue
        of, marked = range(first, end), set()
        if scans[first]:
            scan = _Scan(cities[first:end], artists[first:end], list(titles[first:end]))
            lists = [[k for k, place in enumerate(places[first:end]) if low <= place <= high] for low, high in ((0, 0), (1, 1), (2, 1 << 30))]
            combined, took = scan.merge(lists[1], lists[2]) if lists[2] else (lists[1], set())
            own, marked = scan.merge(lists[0], combined)
            for k in took | marked:
                artists[first + k], titles[first + k] = scan.artist[k], scan.title[k]
            of, marked = sorted(first + k for k in own), {first + k for k in marked}
        stays.extend(of)
        actions.extend(("new" if places[k] else "kept") + "+enriched" * (k in marked) for k in of)
        first = end
    for c, values in (("artist", artists), ("title", titles)):
        rows = rows.set_column(rows.column_names.index(c), c, pa.array(values, pa.string()))
    return rows.drop_columns(["scan", "place"]).take(pa.array(stays, pa.int64())).append_column("action", pa.array(actions, pa.string()))


def _scan(batches):
    """What is scanned together as it streams by in order; what goes on in the next batch waits for its end."""
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        scans = rows.column("scan")
        last = scans[-1].as_py()
        cut = pc.index(scans, scans[-1]).as_py() if last else len(scans)
        if held and (cut or held[0].column("scan")[0].as_py() != last):
            yield from _decided(pa.concat_tables([*held, rows.slice(0, cut)])).to_batches()
            held = []
        elif cut:
            yield from _decided(rows.slice(0, cut)).to_batches()
        if cut < len(scans):
            held.append(rows.slice(cut))
    if held:
        yield from _decided(pa.concat_tables(held)).to_batches()


def merge(primary: DataFrame, secondary: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """The primary list with the secondary rows that are new, in order (side, ord), and ``action``.

    Rows need ``ord``, unique in each list.  Undated rows match nothing and are all kept; they
    are dealt by ``ord``.  One shuffle brings each start date together, or each component of a crowded one; its rows stream by
    sorted, and only one date's or component's are held.  All columns go through Python, so give none that is not needed.
    """
    return merge_all(primary, [secondary], crowded)


def _spread(rows: DataFrame, crowded: int) -> DataFrame | None:
    """The start dates that go by components: of some ``crowded`` kinds, by which the work of a scan grows, or 100 times as many rows, which it holds."""
    kinds = F.approx_count_distinct(F.xxhash64("city", "artist", "title"))
    found = rows.filter("start_date <> ''").groupBy("start_date").agg(kinds.alias("kinds"), F.count(F.lit(1)).alias("n"))
    found = checkpointed(found.filter((F.col("kinds") >= crowded) | (F.col("n") >= 100 * crowded)).select("start_date"))
    return None if found.isEmpty() else found


def _by_component(both: DataFrame, days: DataFrame) -> DataFrame:
    """Rows with ``scan``: their start date, and on crowded dates also the component of what they may ever match.

    A row changes in the merge by an artist that it takes from a row that matches it, and then also by
    its raw title, which becomes that artist in brackets and the title without its first brackets.  Its city and its
    normalised title stay.  So these cover all matches to come, cities aside:
    rows of one artist; normalised titles that contain each other; and for titles too short to be normalised, raw titles and those without
    brackets that contain each other, and the artists that such a title may meet in the brackets of an enriched one.
    """
    days = F.broadcast(days) if days.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS else days
    rows = both.join(days, "start_date", "left_semi").select("start_date", "title", F.coalesce("artist", F.lit("")).alias("artist")).distinct()
    rows = rows.withColumn("norm_title", normalize_title(F.col("title")))
    own = F.when(_short(), F.concat(F.lit("raw "), "title")).otherwise(F.concat(F.lit("plain "), "norm_title"))
    node = lambda text: F.xxhash64("start_date", text)
    rows = checkpointed(rows.withColumns({"own": node(own), "bare": F.regexp_replace("title", "^【.*?】", "")}))
    plain = rows.filter(~_short()).select("start_date", "own", F.lit("plain").alias("kind"), F.col("norm_title").alias("text"))
    short = rows.filter(_short())
    raw_days = short.select("start_date").distinct()
    raw = rows.join(raw_days, "start_date", "left_semi")
    raw = raw.select("start_date", "own", F.explode(F.array_distinct(F.array("title", "bare"))).alias("text")).withColumn("kind", F.lit("raw"))
    held = plain.unionByName(raw.select(plain.columns))
    named_ = held.select("start_date", "kind", "text").distinct()
    # Of raw titles only the short ones' matter, on either side.
    scarce = short.select("start_date", F.lit("raw").alias("kind"), F.explode(F.array_distinct(F.array("title", "bare"))).alias("text")).distinct()
    keys = ["start_date", "kind"]
    plain_named = named_.filter("kind = 'plain'")
    inside = contained(plain_named, plain_named, keys).unionByName(contained(scarce, named_, keys)).unionByName(contained(named_.filter("kind = 'raw'"), scarce, keys))
    of = held.select("start_date", "kind", "text", "own").distinct()
    ends = inside.join(of.withColumnRenamed("text", "needle").withColumnRenamed("own", "a"), [*keys, "needle"]).join(of.withColumnRenamed("text", "hay").withColumnRenamed("own", "b"), [*keys, "hay"]).select("a", "b")
    artist = lambda c: node(F.concat(F.lit("artist "), c))
    by_artist = rows.filter(has("artist")).select(F.col("own").alias("a"), artist(F.col("artist")).alias("b"))
    # A short title within 【P】, or one that begins with an end of 【P and goes on behind it.
    brackets = rows.filter(has("artist")).select("start_date", F.concat(F.lit("【"), "artist", F.lit("】")).alias("text")).distinct()
    part = F.explode(F.array_distinct(F.array("title", F.concat(F.substring_index("title", "】", 1), F.lit("】")))))
    asked = short.select("start_date", "own", "title", part.alias("text"))
    asked = asked.filter((F.col("text") == F.col("title")) | F.contains("title", F.lit("】")))
    hits = contained(asked, brackets, ["start_date"]).withColumnRenamed("needle", "text").join(asked.select("start_date", "text", "own").distinct(), ["start_date", "text"])
    in_brackets = hits.select(F.col("own").alias("a"), artist(F.substring("hay", F.lit(2), F.length("hay") - 2)).alias("b"))
    # An artist with brackets in the name leaves no rule, so all short titles of its date go with it.
    odd = rows.filter(F.contains("artist", F.lit("】"))).select("start_date", artist(F.col("artist")).alias("b")).distinct().join(short.select("start_date", F.col("own").alias("a")), "start_date").select("a", "b")
    found = components(ends.unionByName(by_artist).unionByName(in_brackets).unionByName(odd))
    parts = rows.select("start_date", "title", "own").distinct().join(found, F.col("own") == F.col("node"), "left")
    parts = parts.select(F.col("start_date").alias("day"), F.col("title").alias("of"), F.coalesce("component", "own").cast("string").alias("part"))
    marked = both.join(days.withColumn("many", F.lit(True)), "start_date", "left")
    # Rows of other dates have no part; they look for it under keys of their own, so that they do not meet in one task.
    day = F.when(F.col("many"), F.col("start_date")).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    marked = marked.withColumn("asked", day).join(parts, (F.col("asked") == F.col("day")) & F.col("title").eqNullSafe(F.col("of")), "left")
    return marked.select(*both.columns, F.concat_ws(" ", "start_date", "part").alias("scan"))


def as_list(merged: DataFrame) -> DataFrame:
    """A merged list as an input of the next merge: places become one order."""
    return merged.withColumn("ord", F.col("side").cast("long") * F.lit(1 << 60) + F.col("ord")).drop("side", "action")


def stored_order(stored: DataFrame) -> DataFrame:
    """Stored rows with ``ord`` for a merge: by date text, then id, within their start date; undated rows match nothing and are only dealt."""
    start = start_date(F.col("date"))
    place = F.row_number().over(Window.partitionBy(start, F.when(start == "", F.col("id"))).orderBy("date", "id"))
    return stored.withColumn("ord", F.when(start == "", F.pmod(F.xxhash64("id"), F.lit(1 << 40))).otherwise(place.cast("long")))


def merge_all(existing: DataFrame, sources: list[DataFrame], crowded: int = CROWDED) -> DataFrame:
    """Sources merged by priority, then into the existing list, which wins.

    Start dates never meet, so all steps of one are taken in the scan that has its rows, after one shuffle.
    """
    both = existing.withColumns({"side": F.lit(0), "place": F.lit(0)})
    for k, source in enumerate(sources):
        place = F.col("ord") + F.lit(k << 52) if k else F.col("ord")
        both = both.unionByName(source.withColumns({"ord": place, "side": F.lit(1), "place": F.lit(k + 1)}))
    both = both.withColumn("start_date", F.coalesce(start_date(F.col("date")), F.lit("")))
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.schema if f.name not in ("start_date", "place"))
    days = _spread(both, crowded)
    both = both.withColumn("scan", F.col("start_date")) if days is None else _by_component(both, days)
    key = F.when(F.col("start_date") == "", F.col("ord").cast("string")).otherwise(F.col("scan"))
    sorted_ = both.repartition(key).drop("start_date").sortWithinPartitions("scan", "place", "ord")
    return sorted_.mapInArrow(_scan, f"{columns}, action string")


def summary(merged: DataFrame, before: int | None = None) -> DataFrame:
    """n_new, n_enriched, total_combined, total_new: counted before the store drops repeated ids.

    ``before``: the rows of the primary list, all of which the merge keeps, so they need no count of their own.
    """
    return merged.agg(
        F.count_if(F.col("action").startswith("new")).alias("n_new"),
        F.count_if(F.col("action").endswith("+enriched")).alias("n_enriched"),
        F.count(F.lit(1)).alias("total_combined"),
        F.count_if(F.col("side") == 1).alias("added"),
    ).select("n_new", "n_enriched", "total_combined", (F.col("added") if before is None else F.col("total_combined") - before).alias("total_new"))
