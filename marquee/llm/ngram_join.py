"""N-gram Jaccard join: who is linked with whom through near-equal shingle sets.

1.  Each text becomes the sorted array of its distinct shingle hashes.  Equal arrays are one
    class, known by the smallest 64-bit hash of its texts, so ids may be null or repeat.
2.  Repeated shingles.  All shingles meet in buckets by hash, where it shows which of them
    another class has too.  A class with fewer of those than a link takes has no link and
    is done; a shared passage alone leaves it so.
3.  Candidates.  The shingles of the others have one order, rare ones first by counts in
    hashed buckets.  Linked sets share one of their first shingles, a fifth of a set or less.
    Sets that share a key are joined in a star, in the task first and then across tasks.
4.  The candidate components are cut into blocks of about equal bytes by size, from counts
    of each size, so that no task sees a component whole.  Each pair of blocks whose sizes allow a link, and that is not one component already, is a tile.  In a tile hashed bitmaps and their bit counts
    bound every overlap from above; pairs that may link are settled by intersecting the
    sorted arrays, unless the tile has connected them already.
5.  The components of the links are the result.

No step is approximate but for equal 64-bit hashes of different shingles.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from marquee.llm.common import WordHashes, materialise, slices, texts, window_hashes, written
from marquee.llm.components import components, contract

#: Words of a shingle; linked are sets with 100 * intersection >= PERCENT * union.
WIDTH, PERCENT = 5, 80
#: Bytes of shingle hashes and number of sets in a block, and classes that a task remembers to skip their copies.
BLOCK_BYTES, BLOCK_SETS, SEEN = 6 << 20, 4096, 300_000
#: Characters of text for each bucket of shingles that a task compares.
BUCKET_CHARS = 24_000_000
#: Words of a bitmap for each 64 shingles of the largest set in a tile.
BITMAP = 4
#: log2 of the buckets in which occurrences of shingles are counted, and blocks in which the counts are added up.
BITS, BLOCKS = 20, 64
_BUCKET = np.uint64((1 << BITS) - 1)

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingles(text: str, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a shorter text is one shingle."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    return np.unique(window_hashes(hashes.of(words), width))


def digest(own: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(own.tobytes())


def common(counts: np.ndarray) -> np.ndarray:
    """A place in the order of shingles for each bucket: the more often its shingles occur, the later."""
    return np.minimum(counts, (1 << 32) - 1).astype(np.uint64)


def keys(sets: list[np.ndarray], counts: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys of some sets, and the place of each key's set among them.

    In one order of all shingles, rare ones first, two sets of which the larger has n and that
    share ceil(percent * n / 100) shingles at least have one in common among the first
    size - ceil(percent * size / 100) + 1 of each.
    """
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.lexsort((flat, counts[(flat & _BUCKET).astype(np.int64)], owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < (sizes + (-percent * sizes) // 100 + 1)[owner]
    return flat[order][first], owner[first]


def _stars(found: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, id) rows: the distinct keys with their smallest ids, and edges from those to the others."""
    order = np.lexsort((ids, found))
    found, ids = found[order], ids[order]
    first = np.empty(len(found), bool)
    first[:1] = True
    first[1:] = found[1:] != found[:-1]
    hub = ids[first][np.cumsum(first) - 1]
    edge = hub != ids
    return found[first], ids[first], hub[edge], ids[edge]


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique(np.stack([a, b], 1), axis=0) if len(a) else np.empty((0, 2), np.int64)
    return both[:, 0], both[:, 1]


def bitmaps(sets: list[np.ndarray], words: int) -> np.ndarray:
    out = np.zeros((len(sets), words), np.uint64)
    for row, own in zip(out, sets, strict=True):
        at = (own >> np.uint64(7)) % np.uint64(64 * words)
        np.bitwise_or.at(row, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def settle(ids: list[int], sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Links of a tile that connect what its links connect: between its sides, or within it if it has one side."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    sets, side = [sets[i] for i in order], side[order]
    names = [ids[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    map_ = bitmaps(sets, max(4, BITMAP * int(sizes[-1]) // 64))
    one = bool((side == side[0]).all())
    root = np.arange(len(sets))
    left, right = [], []
    for i in range(1, len(sets)):
        low = int(np.searchsorted(sizes, -(-percent * sizes[i] // 100)))
        near = np.arange(low, i)
        near = near[(root[near] != root[i]) & (one | (side[near] != side[i]))]
        while len(near):
            part, near = near[:4096], near[4096:]
            part = part[root[part] != root[i]]
            more = np.bitwise_count(map_[part] & ~map_[i]).sum(1)
            less = np.bitwise_count(map_[i] & ~map_[part]).sum(1)
            most = np.minimum(sizes[part] - more, sizes[i] - less)
            may = 100 * most >= percent * (sizes[part] + sizes[i] - most)
            for j in part[may][np.argsort(-most[may], kind="stable")]:
                if root[j] == root[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if 100 * both >= percent * (sizes[i] + sizes[j] - both):
                    left.append(names[i])
                    right.append(names[j])
                    root[root == root[i]] = root[j]
    return left, right


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, class_id.

    Words are lower-cased in A-Z; a text shorter than ``width`` words is one shingle.  Null,
    empty and blank texts have no shingles and are linked with nothing: they are components
    of their own.  class_id is the smallest doc_id with the same set, component_id the
    smallest of the component; both are null where no row has a doc_id.  Rows are linked by
    their texts: those that repeat a doc_id with another text, or have none, are linked and
    link like any.  An empty table gives no row; extra columns are ignored.
    """
    spark = docs.sparkSession
    held = texts(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    fewest = next(n for n in range(1, 1000) if 100 * n >= percent * (n + 1))  # smaller sets link with equal ones only
    least = 2 * spark.sparkContext.defaultParallelism
    buckets = max(8, least, int(held.agg(F.sum(F.length("text"))).first()[0] or 0) // BUCKET_CHARS)

    def describe(batches):
        """The shingles of each class of a chunk of texts by bucket, and with the first of them a row for each text."""
        hashes, seen = WordHashes(), set()
        for ids, rows, texts_ in slices(batches, ("doc_id", "text", "h")):
            sets = [shingles(t, hashes, width) for t in rows]
            names = [digest(s) if len(s) else None for s in sets]
            new: dict[bytes, np.ndarray] = {}
            for s, name in zip(sets, names, strict=True):
                if len(s) >= fewest and name not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(name)
                    new[name] = s
            yield _dealt(new, buckets, ids, texts_, [len(s) for s in sets], names)

    kinds = "bucket int, keys binary, owners binary, lengths binary, ids array<long>, texts array<long>, sizes array<long>, names array<binary>"
    dealt = held.mapInArrow(describe, kinds).repartitionById(buckets, F.col("bucket"))  # a task has one bucket
    described = materialise(dealt.mapInArrow(_repeated, "doc_id long, h long, n_shingles long, digest binary, owner long, repeated long"))
    table = described.filter("repeated IS NULL").drop("h", "owner", "repeated")
    classes = described.filter("repeated IS NULL AND digest IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.min("h").alias("node"), F.max("n_shingles").alias("n_shingles"), F.max("owner").alias("owner"))
    classes = materialise(classes)
    repeated = described.filter("repeated IS NOT NULL").groupBy("owner").agg(F.sum("repeated").alias("repeated"))
    able = classes.join(repeated, "owner").filter(F.col("repeated") * 100 >= F.col("n_shingles") * percent)
    able = materialise(able.select("node", "n_shingles"))
    # Copies of a text become one in their task, before the shuffle.
    once = held.groupBy(F.col("h").alias("node")).agg(F.first("text").alias("text"))
    held = written(once.join(able, "node").select("node", "text"))

    def count(batches):
        """The task's counts of shingles."""
        hashes, counts = WordHashes(), np.zeros(1 << BITS, np.uint32)
        for (rows,) in slices(batches, ("text",)):
            for text in rows:
                np.add.at(counts, (shingles(text, hashes, width) & _BUCKET).astype(np.int64), 1)
        blocks = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, BLOCKS)] if counts.any() else []
        yield pa.RecordBatch.from_pydict({"block": pa.array(range(len(blocks)), pa.int32()), "counts": pa.array(blocks, pa.binary())})

    counts = np.zeros(1 << BITS, np.uint64)
    for row in held.mapInArrow(count, "block int, counts binary").repartitionById(BLOCKS, F.col("block")).mapInArrow(_added, "block int, counts binary").collect():  # 2 ** BITS sums in all
        counts[row.block * len(counts) // BLOCKS : (row.block + 1) * len(counts) // BLOCKS] = np.frombuffer(zlib.decompress(row.counts), np.uint64)
    ranks = spark.sparkContext.broadcast(common(counts))
    buckets = max(8, least, int(able.agg(F.sum("n_shingles")).first()[0] or 0) // 8_000_000)
    packed = "bucket int, keys binary, ids binary, a binary, b binary"

    def candidates(batches):
        hashes = WordHashes()
        for ids, rows in slices(batches, ("node", "text")):
            sets = [shingles(text, hashes, width) for text in rows]
            if sets:
                found, owner = keys(sets, ranks.value, percent)
                found, hub, a, b = _stars(found, np.array(ids, np.int64)[owner])
                where = (found % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                found, hub, ends = found[order], hub[order], np.searchsorted(where[order], np.arange(buckets + 1))
                cuts = [slice(x, y) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                edges: list = [[None] * buckets, [None] * buckets]
                for rows_, x in zip(edges, _distinct(a, b), strict=True):
                    rows_[int(found[0] % np.uint64(buckets))] = x.tobytes()
                yield pa.RecordBatch.from_pydict({"bucket": pa.array(range(buckets), pa.int32()), "keys": pa.array([found[c].tobytes() for c in cuts], pa.binary()), "ids": pa.array([hub[c].tobytes() for c in cuts], pa.binary()), "a": pa.array(edges[0], pa.binary()), "b": pa.array(edges[1], pa.binary())})

    def meet(batches):
        found, ids = {}, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["a"]:
                    yield _edges(np.frombuffer(row["a"], np.int64), np.frombuffer(row["b"], np.int64))
                found.setdefault(row["bucket"], []).append(np.frombuffer(row["keys"], np.uint64))
                ids.setdefault(row["bucket"], []).append(np.frombuffer(row["ids"], np.int64))
        for bucket in list(found):
            _, _, a, b = _stars(np.concatenate(found.pop(bucket)), np.concatenate(ids.pop(bucket)))
            yield _edges(*_distinct(a, b))

    def shared_keys(batches):
        return contract(meet(batches))

    shared = held.mapInArrow(candidates, packed).repartitionById(buckets, F.col("bucket")).mapInArrow(shared_keys, "a long, b long")
    near = components(shared, contracted=True).withColumnRenamed("component", "near")

    sized = materialise(near.join(able, "node"))
    # Where the sets of each size of a component lie among its bytes, by size; sets of one size are dealt evenly to the blocks there.
    weight = F.col("n") * (F.col("n_shingles") * 8 + block_bytes // BLOCK_SETS)
    smaller = Window.partitionBy("near").orderBy("n_shingles").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sized.groupBy("near", "n_shingles").agg(F.count(F.lit(1)).alias("n")).withColumn("start", F.coalesce(F.sum(weight).over(smaller), F.lit(0)))
    spans = materialise(sizes.select("near", "n_shingles", F.floor(F.col("start") / block_bytes).alias("low"), F.floor((F.col("start") + weight - 1) / block_bytes).alias("high")))
    block = F.col("low") + F.pmod(F.xxhash64("node"), F.col("high") - F.col("low") + 1)
    sized = materialise(sized.join(spans, ["near", "n_shingles"]).select("node", "near", "n_shingles", block.alias("block")))

    def load(batches):
        hashes = WordHashes()
        for ids, rows, where in slices(batches, ("node", "text", "seats")):
            sets = [shingles(t, hashes, width).tobytes() for t in rows]
            flat = [(s["near"], s["i"], s["j"], s["block"], k) for k, seats in enumerate(where) for s in seats]
            for at in range(0, len(flat), 2000):
                part = flat[at : at + 2000]
                yield pa.RecordBatch.from_pydict({"near": pa.array([p[0] for p in part], pa.int64()), "i": pa.array([p[1] for p in part], pa.int64()), "j": pa.array([p[2] for p in part], pa.int64()), "block": pa.array([p[3] for p in part], pa.int64()), "node": pa.array([ids[p[4]] for p in part], pa.int64()), "own": pa.array([sets[p[4]] for p in part], pa.binary())})

    def link(group: pa.Table) -> pa.Table:
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("own")]
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip("ab", settle(group.column("node").to_pylist(), sets, group.column("block").to_numpy(), percent), strict=True)})

    def links(tiles: DataFrame) -> DataFrame:
        """The links of tiles (near, i, j)."""
        sides = tiles.select("near", F.col("i").alias("block"), "i", "j").unionByName(tiles.filter("i <> j").select("near", F.col("j").alias("block"), "i", "j"))
        seats = sized.join(sides, ["near", "block"]).groupBy("node").agg(F.collect_list(F.struct("near", "i", "j", "block")).alias("seats"))
        rows = held.join(seats, "node").mapInArrow(load, "near long, i long, j long, block long, node long, own binary")
        return materialise(rows.groupBy("near", "i", "j").applyInArrow(link, "a long, b long"))

    def tiles(ends: DataFrame, which) -> DataFrame:
        """Pairs of blocks of a candidate component whose sizes allow links."""
        x, y = ends.alias("x"), ends.alias("y")
        fit = (F.col("x.near") == F.col("y.near")) & (F.col("x.block") <= F.col("y.block")) & (100 * F.col("x.high") >= percent * F.col("y.low"))
        return x.join(y, fit & which).select(F.col("x.near").alias("near"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))

    # Blocks with themselves and with the next come first; they mostly connect what there is to connect.
    ends = sized.groupBy("near", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"))
    near_tiles = F.col("y.block") - F.col("x.block") <= 1
    first = links(tiles(ends, near_tiles))
    found = components(first)  # node, component
    # Then the pairs of blocks further apart, but for those that are one component already.
    large = sized.join(ends.filter("block >= 2").select("near").distinct(), "near", "left_semi")
    named_blocks = large.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ends = named_blocks.groupBy("near", "block").agg(F.min("n_shingles").alias("low"), F.max("n_shingles").alias("high"), F.min("component").alias("from"), F.max("component").alias("to"))
    open_ = ~((F.col("x.from") == F.col("x.to")) & (F.col("y.from") == F.col("y.to")) & (F.col("x.from") == F.col("y.from")))
    far = materialise(tiles(materialise(ends), ~near_tiles & open_))
    if not far.isEmpty():
        found = components(first.unionByName(links(far)))
    linked = materialise(classes.select("node", "class_id").join(found, "node"))
    ids = linked.groupBy("component").agg(F.min("class_id").alias("component_id"))
    final = classes.join(linked.join(ids, "component").select("node", "component_id"), "node", "left").select("digest", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    joined = table.join(materialise(final), "digest", "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _dealt(sets: dict[bytes, np.ndarray], buckets: int, ids: list, texts_: list, sizes: list, names: list) -> pa.RecordBatch:
    """A row for each bucket with 32 bits of each shingle, and of each set there its name's first 8 bytes and its number of shingles."""
    flat = np.concatenate([np.empty(0, np.uint64), *sets.values()])
    owner = np.repeat(np.array([int.from_bytes(n[:8], "little", signed=True) for n in sets], np.int64), [len(s) for s in sets.values()])
    where = (flat % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    where = where[order]
    ends = np.searchsorted(where, np.arange(buckets + 1))
    short, owner = (flat >> np.uint64(32)).astype(np.uint32)[order], owner[order]
    # Runs of one set in one bucket; a bucket without shingles has none.
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (where[1:] != where[:-1])
    starts = np.flatnonzero(new)
    lengths = np.diff(starts, append=len(owner)).astype(np.uint32)
    names_, cuts = owner[starts], np.searchsorted(starts, ends)
    rows: list[list] = [[], [], []]
    for x, y, a, b in zip(ends[:-1], ends[1:], cuts[:-1], cuts[1:], strict=True):
        rows[0].append(short[x:y].tobytes())
        rows[1].append(names_[a:b].tobytes())
        rows[2].append(lengths[a:b].tobytes())
    first = zlib.crc32(repr(ids[:1]).encode()) % buckets
    told = lambda values: [values if i == first else None for i in range(buckets)]
    columns = {"bucket": pa.array(range(buckets), pa.int32())} | {k: pa.array(v, pa.binary()) for k, v in zip(("keys", "owners", "lengths"), rows, strict=True)}
    columns |= {"ids": pa.array(told(ids), pa.list_(pa.int64())), "texts": pa.array(told(texts_), pa.list_(pa.int64())), "sizes": pa.array(told(sizes), pa.list_(pa.int64())), "names": pa.array(told(names), pa.list_(pa.binary()))}
    some = np.flatnonzero((ends[1:] > ends[:-1]) | (np.arange(buckets) == first))
    return pa.RecordBatch.from_pydict(columns).take(pa.array(some))


def _repeated(batches):
    """The rows of texts as they come, and for each set how many of a bucket's shingles another set has too; a task has one bucket.

    Shingles of two sets that agree in 32 bits of a bucket pass for equal, so a count may be too large but never too small.
    """
    held: dict[int, list] = {}
    for batch in batches:
        for row in batch.to_pylist():
            if row["ids"] is not None:
                owners = [None if n is None else int.from_bytes(n[:8], "little", signed=True) for n in row["names"]]
                yield _told(row["ids"], row["texts"], row["sizes"], row["names"], owners, [None] * len(owners))
            if row["keys"]:
                held.setdefault(row["bucket"], []).append([np.frombuffer(row[k], t) for k, t in (("keys", np.uint32), ("owners", np.int64), ("lengths", np.uint32))])
    for bucket in list(held):
        parts = held.pop(bucket)
        # A set that several tasks have dealt counts once; what is equal within a set then are different shingles.
        runs = np.concatenate([own for _, own, _ in parts])
        first = np.zeros(len(runs), bool)
        first[np.unique(runs, return_index=True)[1]] = True
        firsts = np.split(first, np.cumsum([len(own) for _, own, _ in parts])[:-1])
        parts = [(keys[np.repeat(f, n)], own[f], n[f]) for (keys, own, n), f in zip(parts, firsts, strict=True)]
        for top in range(8):  # an eighth of the shingles at a time, to sort in little memory
            mine = [keys >> np.uint32(29) == top for keys, _, _ in parts]
            found = np.concatenate([keys[m] for (keys, _, _), m in zip(parts, mine, strict=True)])
            owners = np.concatenate([np.repeat(own, n)[m] for (_, own, n), m in zip(parts, mine, strict=True)])
            order = np.lexsort((owners, found))
            found, owners = found[order], owners[order]
            new = np.ones(len(found), bool)
            new[1:] = found[1:] != found[:-1]
            starts = np.flatnonzero(new)
            lengths = np.diff(starts, append=len(found))
            again = np.repeat(owners[starts] != owners[starts + lengths - 1], lengths)
            names, n = np.unique(owners[again], return_counts=True)
            nothing = [None] * len(names)
            yield _told(nothing, nothing, nothing, nothing, names, n)


def _told(ids, texts_, sizes, names, owners, repeated) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "h": pa.array(texts_, pa.int64()), "n_shingles": pa.array(sizes, pa.int64()), "digest": pa.array(names, pa.binary()), "owner": pa.array(owners, pa.int64()), "repeated": pa.array(repeated, pa.int64())})


def _added(batches):
    """Sums of the counts of each block, as they stream by."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for row in batch.to_pylist():
            own = sums.setdefault(row["block"], np.zeros((1 << BITS) // BLOCKS, np.uint64))
            own += np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    yield pa.RecordBatch.from_pydict({"block": pa.array(sums, pa.int32()), "counts": pa.array([zlib.compress(x.tobytes(), 1) for x in sums.values()], pa.binary())})


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])
