"""Compression of vectors to codes of four codebook entries, found by a GNAT over the entries.

A vector is cut into parts; each part position has a codebook of at most ``entries`` integer vectors.
A geometric near-neighbour access tree (GNAT) has split points, far from each other; every other
entry lies below the split point next to it, and of each child the range of its distances to each split
point of its node is stored.  A query's distance to a split point eliminates each child
whose range lies further off than the best entry so far.  Ranges are rounded outwards and distances in the
query's disfavour, so a child goes only if all of it is strictly further; what is left is compared by
integer squares, with ties to the lower index.

Each round is one pass over the vectors: a task adds up the parts that each entry gets, and the
sums of all tasks meet in an aggregate of at most parts * entries rows, which the driver turns into the next codebooks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.common import materialise

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Split points of a node, and entries that a node without children has at most.
FANOUT, LEAF = 16, 24
#: Integer components lie within this, so that all squares and their sums fit 63 bits.
LIMIT = 1 << 26
#: Vectors that a task compares at once.
TOGETHER = 8192


def squares(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer points to integer entries."""
    most = max(int(np.abs(points).max(initial=0)), int(np.abs(entries).max(initial=0)))
    if 4 * most * most * points.shape[1] < 1 << 53:  # exact in doubles
        p, e = points.astype(np.float64), entries.astype(np.float64)
        return ((p * p).sum(1)[:, None] + (e * e).sum(1) - 2 * (p @ e.T)).astype(np.int64)
    return np.stack([((points - e) ** 2).sum(1) for e in entries], 1)


def root_below(n: np.ndarray) -> np.ndarray:
    """The integer square root, rounded down."""
    r = np.sqrt(n.astype(np.float64)).astype(np.int64)
    r -= r * r > n
    return r + ((r + 1) * (r + 1) <= n)


def root_above(n: np.ndarray) -> np.ndarray:
    r = root_below(n)
    return r + (r * r < n)


class Gnat:
    """The entries of one codebook; ``nearest`` gives for each point the index of the nearest and the squared distance."""

    def __init__(self, entries: np.ndarray, fanout: int = FANOUT, leaf: int = LEAF):
        self.entries, self.fanout, self.leaf = entries, fanout, leaf
        self.top = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> tuple:
        """(indices of split points, children, least and most distances of split point i to child j)."""
        if len(own) <= self.leaf:
            return own, [], None, None
        points = self.entries[own]
        picked = [0]
        near = squares(points, points[:1])[:, 0]
        while len(picked) < self.fanout:
            picked.append(int(near.argmax()))  # the one furthest from those picked
            near = np.minimum(near, squares(points, points[picked[-1:]])[:, 0])
        picked = list(dict.fromkeys(picked))  # fewer where the rest are copies
        d = squares(points, points[picked])
        home = d.argmin(1)
        home[picked] = -1
        children, low, high = [], np.zeros((len(picked), len(picked)), np.int64), np.zeros((len(picked), len(picked)), np.int64)
        for j in range(len(picked)):
            below = np.flatnonzero(home == j)
            # Of a node of copies alone all would go to one child again.
            inner = (own[below], [], None, None) if len(picked) == 1 else self._node(own[below])
            children.append(inner if len(below) else None)
            if len(below):
                low[:, j], high[:, j] = root_below(d[below].min(0)), root_above(d[below].max(0))
        return own[picked], children, low, high

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, code = np.full(len(points), 1 << 62, np.int64), np.zeros(len(points), np.int64)
        if len(points) and len(self.entries):
            self._visit(self.top, points, np.arange(len(points)), best, code)
        return code, best

    def _visit(self, node: tuple, points: np.ndarray, rows: np.ndarray, best: np.ndarray, code: np.ndarray) -> None:
        own, children, low, high = node
        d = squares(points[rows], self.entries[own])
        least = d.min(1)
        # own is ascending in leaves but not in split points, so ties go by index.
        index = np.where(d == least[:, None], own, len(self.entries)).min(1)
        better = (least < best[rows]) | ((least == best[rows]) & (index < code[rows]))
        best[rows[better]], code[rows[better]] = least[better], index[better]
        if not children:
            return
        down, up, first = root_below(d), root_above(d), d.argmin(1)
        for nearby in (True, False):  # the child of the next split point first, so that more of the others go
            for j, child in enumerate(children):
                if child is None:
                    continue
                mine = np.flatnonzero((first == j) == nearby)
                reach = root_above(best[rows[mine]])[:, None]
                out = ((down[mine] - reach > high[:, j]) | (up[mine] + reach < low[:, j])).any(1)
                if not out.all():
                    self._visit(child, points, rows[mine[~out]], best, code)


def _points(batch, column: str, dim: int) -> np.ndarray:
    """The vectors of a batch as integers; all have ``dim`` finite components."""
    x = batch.column(column)
    flat = np.floor(x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), dim) * SCALE)
    if np.abs(flat).max(initial=0) > LIMIT:
        raise ValueError(f"a component lies outside of +-{LIMIT // SCALE}")
    return flat.astype(np.int64)


def _is_vector(vector: Column, dim: int | None = None) -> Column:
    whole = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return whole if dim is None else whole & (F.size(vector) == dim)


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    A vector that is null or has a null or non-finite component is left out, and so is one of another length than
    that of the smallest kept id, as it has no parts to compare.  Null ids come last, and equal ids are in the order of
    their vectors; with fewer than ``entries`` vectors the codebooks are as small.  Rows with null labels are one group.
    Repeated rows count each.  A length that ``parts`` does not divide and a component whose
    size is over 65536 are errors.  An empty table gives none; extra columns are ignored.
    """
    spark = vectors.sparkSession
    held = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    first = held.filter(_is_vector(F.col("v"))).orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").first()
    dim = len(first.v) if first else 0
    if dim % parts:
        raise ValueError(f"vectors of length {dim} have no {parts} equal parts")
    held = held.filter(_is_vector(F.col("v"), dim))
    start = [r.v for r in held.orderBy(F.col("vec_id").isNull(), "vec_id", "v").select("v").limit(entries).collect()]
    width = dim // parts
    chosen = np.floor(np.array(start, np.float64).reshape(len(start), dim) * SCALE).astype(np.int64)
    books = [chosen[:, p * width : (p + 1) * width].copy() for p in range(parts)]

    def nearest(books):
        """Of batches: their integer parts, and the entries and squared distances of each part position."""
        shared = spark.sparkContext.broadcast(books)  # parts * entries integer vectors

        def each(batches):
            trees = [Gnat(b) for b in shared.value]
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    some = batch.slice(at, TOGETHER)
                    own = np.split(_points(some, "v", dim), parts, axis=1)
                    yield some, own, [t.nearest(x) for t, x in zip(trees, own, strict=True)]

        return each

    sums = [f"s{k}" for k in range(width)]
    for _ in range(rounds if start else 0):
        each = nearest(books)

        def added(batches, each=each):
            n, total = np.zeros((parts, len(start)), np.int64), np.zeros((parts, len(start), width), np.int64)
            for _, own, found in each(batches):
                for p in range(parts):
                    n[p] += np.bincount(found[p][0], minlength=len(start))
                    np.add.at(total[p], found[p][0], own[p])
            part, entry = np.nonzero(n)
            columns = {"part": part, "entry": entry, "n": n[part, entry]} | {c: total[part, entry, k] for k, c in enumerate(sums)}
            yield pa.RecordBatch.from_pydict({c: pa.array(x, pa.int64()) for c, x in columns.items()})

        kinds = ", ".join(f"{c} long" for c in ("part", "entry", "n", *sums))
        for row in held.select("v").mapInArrow(added, kinds).groupBy("part", "entry").agg(*[F.sum(c) for c in ("n", *sums)]).collect():
            books[row[0]][row[1]] = np.array(row[3:], np.int64) // row[2]
    sha = hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()
    each = nearest(books)

    def coded(batches):
        for some, _, found in each(batches):
            codes = np.stack([c for c, _ in found], 1).astype(np.uint8)
            error = sum(d for _, d in found)
            yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    kinds = {f.name: f.dataType.simpleString() for f in held.schema}
    rows = materialise(held.mapInArrow(coded, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"))
    totals = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))
