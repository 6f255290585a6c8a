"""The stored table: buckets that an upsert touches, writers that meet, batches that run again."""

import threading

import pytest
from pyspark.sql import functions as F

from marquee.operators import store
from marquee.schema import LISTING
from marquee.streaming import uploads as uploads_

SCHEMA = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in LISTING)}, ord long"


def rows(spark, ids, title="t", date="2026.05.01", artist=""):
    return spark.createDataFrame([(i, title, "", date, "上海", "", "", "", "", artist, False, True, 1, k) for k, i in enumerate(ids)], SCHEMA)


def held(c):
    return {r.id: r.title for r in c.read().collect()}


def test_an_upsert_touches_the_buckets_of_its_ids(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=8)
    c.upsert(rows(spark, [f"i{k}" for k in range(400)]))
    before = c.version()
    assert len(before["writes"]) == 8 and len(set(before["writes"].values())) == 1
    c.upsert(rows(spark, ["i3", "new"], "changed"))
    after = c.version()
    moved = {b for b, w in after["writes"].items() if w != before["writes"][b]}
    own = {str(r[0]) for r in spark.createDataFrame([("i3",), ("new",)], "id string").select(store.Catalogue._bucket(8)).collect()}
    assert moved == own and after["number"] == before["number"] + 1
    written = [p for p in (tmp_path / "t" / "data").glob(f"write={after['writes'][own.pop()]}/bucket=*")]
    assert len(written) == len(moved)
    assert len(held(c)) == 401 and held(c)["i3"] == held(c)["new"] == "changed" and held(c)["i4"] == "t"


def test_find_reads_one_bucket(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=8)
    c.upsert(rows(spark, [f"i{k}" for k in range(100)]))
    found = c.find(["i7"])
    assert [r.id for r in found.collect()] == ["i7"] and len({f.rsplit("/", 2)[1] for f in found.inputFiles()}) == 1
    assert c.find(["none"]).count() == 0


def test_two_writers_both_land(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=4)
    c.upsert(rows(spark, ["a"]))
    parts = [rows(spark, [f"w{w}-{k}" for k in range(10)]) for w in range(4)]
    errors = []

    def write(part):
        try:
            store.Catalogue(spark, str(tmp_path / "t"), buckets=4).upsert(part)
        except Exception as error:  # noqa: BLE001
            errors.append(error)

    threads = [threading.Thread(target=write, args=(p,)) for p in parts]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and len(held(c)) == 41 and c.version()["number"] == 5


def test_a_writer_that_comes_second_goes_on_from_the_newer_version(spark, tmp_path):
    c, other = (store.Catalogue(spark, str(tmp_path / "t"), buckets=16) for _ in range(2))
    c.upsert(rows(spark, ["a", "b"]))
    seen = []

    def make(stored):
        seen.append(stored.count())
        if len(seen) == 1:
            other.upsert(rows(spark, ["c"]))
        return rows(spark, [f"of {seen[-1]}"])

    c.change(make)
    assert seen == [2, 3] and set(held(c)) == {"a", "b", "c", "of 3"}
    with pytest.raises(store.Conflict):
        store.Catalogue(spark, str(tmp_path / "t"), tries=2).change(lambda s: [other.upsert(rows(spark, ["d"])), rows(spark, ["e"])][1])


@pytest.mark.parametrize("smart", [False, True])
def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path, smart):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=4)
    c.upsert(rows(spark, ["a"], "foo foo"))
    batch = rows(spark, ["x", "y"], "foo foo", artist="P").withColumnRenamed("updated_at", "updatedAt")
    batch.coalesce(1).write.json(str(tmp_path / "in"))
    run = lambda: uploads_.upsert_stream(uploads_.uploads(spark, str(tmp_path / "in")), c, str(tmp_path / "p"), smart=smart).awaitTermination()
    run()
    first, number = held(c), c.version()["number"]
    assert len(first) == (1 if smart else 3)
    # The batch is done but not yet told to the stream's log, as if the driver had died there.
    (commit,) = [f for f in (tmp_path / "p" / "commits").iterdir() if f.name == "0"]
    commit.unlink()
    (tmp_path / "p" / "commits" / ".0.crc").unlink(missing_ok=True)
    run()
    assert held(c) == first and c.version()["number"] == number


def test_an_upload_that_matches_is_all_that_a_merge_writes(spark, tmp_path):
    stored = rows(spark, ["a", "b", "c"], "foo foo").withColumn("date", F.when(F.col("id") == "c", "2026.06.01").otherwise(F.col("date")))
    c = store.Catalogue(spark, str(tmp_path / "t"))
    c.upsert(stored)
    out = uploads_.merged_upload(c.read(), rows(spark, ["x"], "foo foo", artist="P")).collect()
    assert [(r.id, r.artist) for r in out] == [("a", "P")]


def test_replaced_uploads(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"))
    c.upsert(rows(spark, ["a"]))
    rows(spark, ["b", "b"]).withColumnRenamed("updated_at", "updatedAt").coalesce(1).write.json(str(tmp_path / "in"))
    uploads_.upsert_stream(uploads_.uploads(spark, str(tmp_path / "in")), c, str(tmp_path / "p"), mode="replace").awaitTermination()
    assert set(held(c)) == {"b"}


def test_vacuum(spark, tmp_path):
    c = store.Catalogue(spark, str(tmp_path / "t"), buckets=2)
    for k in range(3):
        c.upsert(rows(spark, ["a", "b", "c", "d"], f"t{k}"))
    c.vacuum()
    assert set(held(c).values()) == {"t2"} and len(list((tmp_path / "t" / "data").iterdir())) == 1 and c.version()["number"] == 3
    c.upsert(rows(spark, ["a"], "again"))
    assert c.version()["number"] == 4 and held(c)["a"] == "again"
