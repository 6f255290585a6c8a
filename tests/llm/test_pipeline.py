"""The stages of the pipeline against brute force."""

import collections
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r, out = random.Random(9), []
    prose = lambda n: [f"w{r.randrange(600)}" for _ in range(n)]
    for k in range(400):
        words = prose(r.randrange(20, 120))
        if k % 7 == 0:
            words[3:3] = ["vile", "nasty"]
        out.append((k, " ".join(words), "en", f"s{k % 4}", 0))
    out += [(500 + k, out[k][1].replace(" ", "\n"), "en", "s0", 0) for k in range(1, 30)]
    for k in range(8):
        words = out[101][1].split()
        words[k] = "edit"
        out.append((600 + k, " ".join(words), "en", None, 0))
    out += [(700, None, "en", "s1", 0), (701, "", None, "s1", 0), (5, out[5][1], "en", "s1", 0)]
    at = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(out, SCHEMA).write.parquet(f"{at}/documents.parquet")
    labels = [(k, 1, int(k % 7 == 0)) for k in range(0, 400) if k % 5]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns
        after.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([tuple(r) for r in docs.collect()])
    good, exact, near, mixed = seen
    kept = {r[0] for r in good}
    assert not any(k % 7 == 0 for k in kept if k < 400) and sum(k % 7 > 0 for k in range(400)) - len([k for k in kept if k < 400]) < 8
    bare = collections.defaultdict(list)
    for r in good:
        bare["".join(WORDS(r[1] or ""))].append(r)
    assert len(exact) == len(bare) and {r[0] for r in exact} == {min(rs, key=lambda r: (-len(r[1] or ""), r[0]))[0] for rs in bare.values()}
    grams = {r[0]: {tuple(WORDS(r[1] or "")[i : i + 5]) for i in range(max(1, len(WORDS(r[1] or "")) - 4))} if WORDS(r[1] or "") else set() for r in exact}
    linked = lambda a, b: grams[a] and grams[b] and 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])
    group = {a: a for a in grams}
    for _ in range(4):
        for a in grams:
            for b in grams:
                if linked(a, b):
                    group[a] = group[b] = min(group[a], group[b])
    assert sorted(r[0] for r in near) == sorted(set(group.values()))
    assert max(collections.Counter(r[0] for r in mixed).values()) <= 3
    pieces = cp.run(spark, folder).collect()
    want = collections.Counter(r[0] for r in mixed)
    assert collections.Counter(p.doc_id for p in pieces if p.start == 0) == want


def test_empty(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_row_keys_take_no_python_worker(spark, folder):
    """The numbers of files are a local table; an RDD of Python rows is read by Python workers that executors keep."""
    rows, key = cp._numbered(spark.read.parquet(f"{folder}/documents.parquet"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "LocalTableScan" in plan and "ExistingRDD" not in plan
    keys = [r[0] for r in rows.select(key).collect()]
    assert len(keys) == len(set(keys)) == spark.read.parquet(f"{folder}/documents.parquet").count()


def test_columns_of_clashing_names(spark, folder, tmp_path):
    docs, names = spark.read.parquet(f"{folder}/documents.parquet").limit(60), ("_row", "row", "_copies", "_copy", "_id", "_text", "_new", "_digest", "h", "kept", "copies", "a.b")
    for name in names:
        docs = docs.withColumn(name, F.lit(7))
    docs.write.parquet(f"{tmp_path}/odd")
    docs = spark.read.parquet(f"{tmp_path}/odd")
    for _, stage in cp.STAGES[:-1]:
        after = stage(spark, docs, folder)
        assert after.columns == docs.columns and {tuple(r)[5:] for r in after.collect()} == {(7,) * len(names)}
    assert cp.packing(spark, docs, folder).count() >= 60


def test_null_and_repeated_ids_with_different_texts(spark, folder):
    r = random.Random(12)
    prose = lambda n: [f"w{r.randrange(600)}" for _ in range(n)]
    base, texts = prose(60), [" ".join(prose(40)) for _ in range(12)]
    toxic = [" ".join(["vile", "nasty", *prose(40)]) for _ in range(6)]
    own = lambda rows: spark.createDataFrame([(d, t, "en", "s0", 0) for d, t in rows], SCHEMA).repartition(3)
    texts_of = lambda df: sorted(x.text for x in df.collect() if x.text)
    docs = spark.read.parquet(f"{folder}/documents.parquet").unionByName(own([(None if k % 2 else 9000, t) for k, t in enumerate(texts + toxic)]))
    good = set(texts_of(cp.quality_classifier(spark, docs, folder)))
    assert not good & set(toxic) and len(good & set(texts)) > 9
    exact = cp.exact_copies(spark, own([(None, s.join(t)) for t in (base, base[::-1]) for s in (" ", "  ", "   ")]), folder)
    assert texts_of(exact) == sorted("   ".join(t) for t in (base, base[::-1]))
    edited = [" ".join([*base[:k], "edit", *base[k + 1 :]]) for k in (0, 59)]
    near = cp.near_copies(spark, own([(None, edited[0]), (7, " ".join(base)), (7, edited[1]), (7, texts[0]), (None, texts[1]), (None, texts[2])]), folder)
    left = texts_of(near)
    assert len(left) == 4 and set(texts[:3]) < set(left) and edited[0] not in left
    mixed = collections.Counter(texts_of(cp.mixing(spark, own([(d, t) for d in (None, 7) for t in texts]), folder)))
    assert sum(mixed.values()) == 24 and max(mixed.values()) <= 6


def test_missing_subpackage_is_guarded_in_the_entry_alone():
    root = Path(cp.__file__).parent
    for file in (root / "corpus_pipeline.py", *(root / "marquee" / "llm").glob("*.py")):
        assert "ImportError" not in file.read_text(encoding="utf-8")
