"""The trie of all conversations by their common first turns.

A conversation is a row of 20-byte tokens, one a turn: the MD5 of role and text, and the text's code points.
1.  All rows are sorted by (tokens, conv_id) over range partitions, so that a conversation that very many
    share is spread by their ids.  How many tokens the last row of a partition has in common with
    the first of the next is known from one pair of rows a partition.
2.  A task has one partition.  Its equal rows become one with a count; the longest common prefixes (LCPs)
    of neighbours get a sparse table of range minima.  A prefix that a row does not share with the row before it is a new
    node; so is each prefix of the partition's first row.  Each of these binary-searches its own left and right
    extent in the table, all at once and without a stack, and has its members as an interval.  In the list of
    nodes by (row, depth) a subtree is an interval too, so its sums are differences of running sums.
3.  A node whose interval meets the partition's edge within what is shared across it is open:
    its parts are added up by a hash of its prefix.  All of its figures add up:
    saved tokens are the code points of the members' turns less those of the distinct nodes.
4.  The ids of conversations that end in a node are hashed as they stream by sorted; those of an open node travel
    in pieces of some PIECE bytes, so what a task holds stays small, though one SHA-256 must read
    its ids one after the other.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import materialise

#: Bytes of a token: an MD5 and the code points of the text.
TOKEN = 20
#: Bytes of rows that a range partition has, about.
PARTITION = 8 << 20
#: Bytes of ids that an open node's row carries at most, about.
PIECE = 1 << 20
#: Conversations of a block, and of how many first turns the first of a block gives some to the others.
BLOCK, MOST = 100, 6
_NONE = hashlib.sha256(b"").hexdigest()


def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Level k has the minimum of each 2**k values."""
    levels = [values]
    while 2 ** len(levels) <= len(values):
        below, half = levels[-1], 2 ** (len(levels) - 1)
        levels.append(np.minimum(below[:-half], below[half:]))
    return levels


def right_extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The last row r such that all of lcp[row + 1 .. r] reach the depth; lcp[i] is shared by rows i - 1 and i."""
    at, n = rows.copy(), len(levels[0])
    for k in reversed(range(len(levels))):
        fits = at + (1 << k) < n
        least = levels[k][np.where(fits, at + 1, 0)]
        at += np.where(fits & (least >= depths), 1 << k, 0)
    return at


def left_extents(levels: list[np.ndarray], rows: np.ndarray, depths: np.ndarray) -> np.ndarray:
    """The first row l such that all of lcp[l + 1 .. row] reach the depth."""
    at = rows.copy()
    for k in reversed(range(len(levels))):
        fits = at - (1 << k) >= 0
        least = levels[k][np.where(fits, at - (1 << k) + 1, 0)]
        at -= np.where(fits & (least >= depths), 1 << k, 0)
    return at


def shared(a: bytes, b: bytes) -> int:
    """Tokens that two rows have in common from the start."""
    n = min(len(a), len(b)) // TOKEN * TOKEN
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return (int(differ[0]) if len(differ) else n) // TOKEN


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its rebuilt row of tokens; a conversation without any turn left has an empty row.

    Turns are in the order of ``turn``, null first; of equal numbers the order is that of the tokens.
    """
    text = F.coalesce("text", F.lit(""))
    role = F.coalesce("role", F.lit(""))
    token = F.concat(F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))), F.unhex(F.lpad(F.hex(F.length(text)), 8, "0")))
    own = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), token.alias("token"))
    rows = own.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "token"))), lambda t: t["token"]).alias("own"))
    rows = materialise(rows.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK))
    heads = rows.filter("conv_id = base").select("base", F.slice("own", 1, MOST - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST).cast("int")
    none = F.array().cast("array<binary>")
    given = F.slice(F.coalesce("head", none), F.lit(1), h)
    kept = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    joined = F.concat(given, kept)
    packed = F.unhex(F.array_join(F.transform(joined, F.hex), ""))
    return rows.join(heads, "base", "left").select("conv_id", packed.alias("row"))


def across(batches):
    """Edges of partitions in order, as they stream by: what the last row of each has in common with the first of the next."""
    last, left, right, common = None, [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if last is not None:
                left.append(last["part"])
                right.append(row["part"])
                common.append(shared(last["last"], row["first"]))
            last = row
    yield pa.RecordBatch.from_pydict({"left": pa.array(left, pa.int32()), "right": pa.array(right, pa.int32()), "common": pa.array(common, pa.int32())})


def edges(batches):
    """The first and the last row of a partition that has some."""
    first = last = part = None
    for batch in batches:
        if batch.num_rows:
            if first is None:
                first, part = batch.column("row")[0].as_py(), batch.column("part")[0].as_py()
            last = batch.column("row")[batch.num_rows - 1].as_py()
    if first is not None:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": pa.array([first], pa.binary()), "last": pa.array([last], pa.binary())})


def _keys(rows: list[bytes], row: np.ndarray, depth: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for the prefix of each wanted node, in two longs; the prefixes of a row are read once."""
    high, low = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
    at, read, sha = -1, 0, None
    for k in np.flatnonzero(wanted).tolist():
        r, end = int(row[k]), int(depth[k]) * TOKEN
        if r != at:
            at, read, sha = r, 0, xxhash.xxh3_128()
        sha.update(rows[r][read:end])
        read = end
        value = sha.digest()
        high[k], low[k] = (int.from_bytes(v, "big", signed=True) for v in (value[:8], value[8:]))
    return high, low


class Ids:
    """Decimal ids of one row's members, hashed as they come."""

    def __init__(self):
        self.sha, self.first = hashlib.sha256(), None

    def add(self, ids: list[int]) -> None:
        text = ",".join(map(str, ids)).encode()
        self.sha.update(text if self.first is None else b"," + text)
        self.first = ids[0] if self.first is None else self.first


def _tasks_rows(batches):
    """Distinct rows of a partition with count and smallest id and the hash of all ids; ids of rows that may end in open nodes also in pieces.

    A piece is (row, smallest id in it, ids as text).
    """
    rows, counts, least, shas, pieces = [], [], [], [], []
    ids = None
    for batch in batches:
        row, conv = batch.column("row"), batch.column("conv_id").to_numpy()
        values = row.to_pylist()
        start = 0
        while start < len(values):
            end = start + 1
            while end < len(values) and values[end] == values[start]:
                end += 1
            own = conv[start:end].tolist()
            if not rows or rows[-1] != values[start]:
                if ids is not None:
                    shas.append(ids.sha.hexdigest())
                    # Open at the end can only be the first row and those that the last row starts with.
                    pieces[:] = [p for p in pieces if p[0] == rows[0] or values[start].startswith(p[0])]
                rows.append(values[start])
                counts.append(0)
                least.append(own[0])
                ids = Ids()
            ids.add(own)
            counts[-1] += len(own)
            for k in range(0, len(own), PIECE // 20):
                part = own[k : k + PIECE // 20]
                pieces.append((rows[-1], part[0], ",".join(map(str, part))))
            start = end
    if ids is not None:
        shas.append(ids.sha.hexdigest())
    return rows, np.array(counts, np.int64), np.array(least, np.int64), shas, pieces


def nodes(batches, before: dict[int, int], after: dict[int, int]):
    """Rows of one partition, sorted: its nodes, closed ones whole and open ones as parts; and pieces of ids that end in open nodes.

    before and after: the tokens that a partition's first row shares with the row before it, and its last with
    the next, -1 where there is none.
    """
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    part = batches[0].column("part")[0].as_py()
    from_left, to_right = before.get(part, -1), after.get(part, -1)
    rows, counts, least, shas, pieces = _tasks_rows(batches)
    n = len(rows)
    length = np.array([len(r) // TOKEN for r in rows], np.int64)
    lcp = np.array([-1, *(shared(a, b) for a, b in zip(rows[:-1], rows[1:], strict=True))], np.int64)
    levels, smallest = sparse_table(lcp), sparse_table(least)

    # The list of nodes by row and depth; the partition's first row has all its prefixes, the root among them.
    begins = lcp + 1
    per_row = length - begins + 1
    first_node = np.cumsum(per_row) - per_row
    total = int(per_row.sum())
    row = np.repeat(np.arange(n), per_row)
    depth = np.arange(total) - first_node[row] + begins[row]
    right = right_extents(levels, row, depth)
    left = left_extents(levels, row, depth)

    points = [np.frombuffer(r, np.uint8).reshape(-1, TOKEN)[:, 16:].astype(np.int64) @ (1 << np.array([24, 16, 8, 0])) for r in rows]
    up_to = [np.concatenate([[0], np.cumsum(p)]) for p in points]  # code points of the first d turns
    whole = np.array([u[-1] for u in up_to], np.int64)
    members = np.concatenate([[0], np.cumsum(counts)])
    turns_sum = np.concatenate([[0], np.cumsum(counts * whole)])
    offset = np.cumsum(length + 1) - (length + 1)
    flat = np.concatenate(up_to)
    above = np.where(depth > 0, flat[offset[row] + np.maximum(depth - 1, 0)], 0)  # before the node's own turn
    own = flat[offset[row] + depth] - above

    n_convs = members[right + 1] - members[left]
    all_points = turns_sum[right + 1] - turns_sum[left] - n_convs * above
    last_node = np.concatenate([first_node[1:], [total]])[right]  # behind the subtree
    here = ~((row == 0) & (depth <= from_left))  # not begun in an earlier partition
    new_points = np.concatenate([[0], np.cumsum(own * here)])
    me = np.arange(total)
    distinct_points = new_points[last_node] - new_points[me]
    next_lcp = np.concatenate([lcp[1:], [to_right]])
    leaf = np.zeros(total, np.int64)
    leaf[first_node + per_row - 1] = next_lcp < length
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    n_leaves = leaves[last_node] - leaves[me]
    # Of the parent, which a row before may have begun, the place in the list.
    begun = left_extents(levels, row, depth - 1)
    parent = np.where(depth > begins[row], me - 1, first_node[begun] + (depth - 1) - begins[begun])
    parent = np.where(depth == 0, -1, parent)
    n_children = np.bincount(parent[parent >= 0], minlength=total)
    conv = _range_min(smallest, left, right)
    opened = ((left == 0) & (depth <= from_left)) | ((right == n - 1) & (depth <= to_right))
    under_open = (parent >= 0) & opened[parent]
    ends = me == first_node[row] + per_row[row] - 1

    high, low = _keys(rows, row, depth, opened)
    up_high, up_low = high[parent], low[parent]
    saved = all_points - distinct_points
    for start in range(0, total, 5000):
        s = slice(start, start + 5000)
        p = parent[s]
        hashes = [shas[r] if e else _NONE for r, e in zip(row[s].tolist(), ends[s].tolist(), strict=True)]
        yield _rows(
            high=high[s], low=low[s], up_high=up_high[s], up_low=up_low[s], opened=opened[s], under_open=under_open[s],
            conv_id=conv[s], depth=depth[s], parent_conv_id=pa.array(np.where(p >= 0, conv[p], 0), mask=(p < 0) | under_open[s]),
            n_convs=n_convs[s], n_children=n_children[s], n_leaves=n_leaves[s], saved=saved[s], ends_sha256=hashes,
        )
    for value, first, text in pieces:
        r = bisect.bisect_left(rows, value)
        k = first_node[r] + per_row[r] - 1
        if opened[k]:
            yield _rows(high=high[k : k + 1], low=low[k : k + 1], opened=opened[k : k + 1], conv_id=np.array([first]), piece=[text])


def _range_min(levels: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The minimum over each interval: of two spans of a power of two that cover it."""
    out = np.empty(len(left), levels[0].dtype)
    k = np.int64(np.floor(np.log2(right - left + 1)))
    for level in np.unique(k):
        at = k == level
        out[at] = np.minimum(levels[level][left[at]], levels[level][right[at] - (1 << int(level)) + 1])
    return out


_LONGS = ("high", "low", "up_high", "up_low", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved")
_KINDS = {"high": pa.int64(), "low": pa.int64(), "up_high": pa.int64(), "up_low": pa.int64(), "opened": pa.bool_(), "under_open": pa.bool_()} | {c: pa.int64() for c in _LONGS[4:]} | {"ends_sha256": pa.string(), "piece": pa.string()}
_SCHEMA = ", ".join(f"{c} {({pa.int64(): 'long', pa.bool_(): 'boolean', pa.string(): 'string'})[k]}" for c, k in _KINDS.items())


def _rows(**columns) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    made = {c: (x.cast(k) if isinstance(x := columns[c], pa.Array) else pa.array(x, k)) if c in columns else pa.nulls(n, k) for c, k in _KINDS.items()}
    return pa.RecordBatch.from_pydict(made)


def ends_of(batches):
    """Pieces of ids ordered by node and first id: the hash of all ids of each node, as they stream by."""
    name, sha, out = None, None, []
    for batch in batches:
        for high, low, text in zip(*(batch.column(c).to_pylist() for c in ("high", "low", "piece")), strict=True):
            if (high, low) != name:
                if name is not None:
                    out.append((*name, sha.hexdigest()))
                name, sha = (high, low), hashlib.sha256()
                sha.update(text.encode())
            else:
                sha.update(b"," + text.encode())
    if name is not None:
        out.append((*name, sha.hexdigest()))
    cols = list(zip(*out, strict=True)) or [()] * 3
    yield pa.RecordBatch.from_pydict({"high": pa.array(cols[0], pa.int64()), "low": pa.array(cols[1], pa.int64()), "sha": pa.array(cols[2], pa.string())})


def prefix_trie(turns: DataFrame, partition_bytes: int = PARTITION) -> DataFrame:
    """One row per node of the trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` has conv_id, turn, role, text.  Null roles and texts count as empty; a row without conv_id belongs to no
    conversation and is left out; null turns come first, rows of equal turn numbers are in the order of their
    tokens, and repeated rows are turns like any.  A very long text is one token; a conversation's tokens must fit a task.
    An empty table has no conversation and gives no row, not even a root.  Extra columns are ignored.
    """
    spark = turns.sparkSession
    rows = materialise(conversations(turns))
    n_bytes = int(rows.agg(F.sum(F.length("row") + 16)).first()[0] or 0)
    parts = max(2 * spark.sparkContext.defaultParallelism, -(-n_bytes // partition_bytes))
    sorted_ = rows.repartitionByRange(parts, "row", "conv_id").sortWithinPartitions("row", "conv_id")
    sorted_ = materialise(sorted_.withColumn("part", F.spark_partition_id()))
    # A number for each partition comes to the driver, which knows the partitions anyway.
    ends = sorted_.mapInArrow(edges, "part int, first binary, last binary").repartition(1).sortWithinPartitions("part")
    ends = ends.mapInArrow(across, "left int, right int, common int").collect()
    before, after = {e.right: e.common for e in ends}, {e.left: e.common for e in ends}
    made = materialise(sorted_.mapInArrow(lambda batches: nodes(batches, before, after), _SCHEMA))

    own = made.filter("piece IS NULL")
    key = ["high", "low"]
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_leaves", "saved")]
    # An open node's parts lie in a row of partitions; its figures add up.
    whole = own.filter("opened").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("up_high").alias("up_high"), F.first("up_low").alias("up_low"), *sums)
    hashes = made.filter("piece IS NOT NULL").select(*key, "conv_id", "piece").repartition(*key).sortWithinPartitions(*key, "conv_id").mapInArrow(ends_of, "high long, low long, sha string")
    under = own.filter("NOT opened AND under_open").select("up_high", "up_low").unionByName(whole.filter("depth > 0").select("up_high", "up_low"))
    children = under.groupBy(F.col("up_high").alias("high"), F.col("up_low").alias("low")).agg(F.count(F.lit(1)).alias("n_children"))
    whole = whole.join(hashes, key, "left").join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))).withColumn("ends_sha256", F.coalesce("sha", F.lit(_NONE)))
    whole = materialise(whole.drop("sha"))
    parents = whole.select(F.col("high").alias("up_high"), F.col("low").alias("up_low"), F.col("conv_id").alias("parent"))
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends_sha256"]
    below = own.filter("NOT opened AND under_open").drop("parent_conv_id").unionByName(whole.drop("parent_conv_id"), allowMissingColumns=True)
    below = below.join(parents, ["up_high", "up_low"], "left").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.col("parent"))).select(shown)
    return own.filter("NOT opened AND NOT under_open").select(shown).unionByName(below).withColumnRenamed("saved", "saved_tokens")

