"""Vector codes and the prefix trie against brute force, with every odd case."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from marquee.llm import prefix_trie as trie, vector_codes as codes


def brute_codes(rows, parts=4, entries=256, rounds=4):
    """Plain Python over exact integers."""
    good = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    ints = [[math.floor(1024 * x) for x in v] for _, v, _ in good]
    w = len(ints[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in ints]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = collections.defaultdict(list)
            for c in cut:
                groups[best(p, c[p])[1]].append(c[p])
            for k, own in groups.items():
                books[p][k] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = [[best(p, c[p]) for p in range(parts)] for c in cut]
    total = collections.Counter()
    for (_, _, lab), f in zip(good, found, strict=True):
        total[lab] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((repr((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[lab], sha))) for (i, _, lab), f in zip(good, found, strict=True))


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 5, "x") for r in rows], "vec_id long, embedding array<float>, label int, part int, code string").repartition(3)


@pytest.mark.parametrize("n,dim,entries", [(90, 8, 40), (300, 4, 256), (20, 16, 256)])
def test_vector_codes(spark, n, dim, entries):
    r = random.Random(n)
    draw = lambda: [np.float32(r.gauss(0, 0.01 if dim == 4 else 1)).item() for _ in range(dim)]  # noqa: E731  many ties at 0.01
    rows = [(i, draw(), r.choice([None, 1, 2])) for i in range(-5, n)]
    rows += [(1000, None, 1), (1001, [None] * dim, 1), (1002, [math.nan] * dim, 1), (1003, [math.inf] * dim, None), (1004, [-math.inf] + [0.0] * (dim - 1), 2)]
    rows += [(3, rows[3][1], 1), (3, rows[3][1], 1), (None, rows[7][1], None), (5, draw(), 2)]
    got = codes.vector_codes(vectors(spark, rows), entries=entries).collect()
    assert sorted(repr(tuple(x)) for x in got) == brute_codes(rows, entries=entries)


def test_vector_codes_of_odd_tables(spark):
    assert codes.vector_codes(vectors(spark, [(1, [0.5] * 8, 1)]).limit(0)).count() == 0
    got = codes.vector_codes(vectors(spark, [(1, [0.5] * 8, 1), (2, [0.5] * 12, 1), (3, [], 1)])).collect()
    assert [(x.vec_id, x.code, x.error) for x in got] == [(1, "00000000", 0)]
    with pytest.raises(Exception, match="outside"):
        codes.vector_codes(vectors(spark, [(1, [1e9] * 8, 1)])).collect()


@pytest.mark.parametrize("spread", [1, 40, 1 << 25])
def test_gnat_finds_the_first_of_the_nearest(spread):
    r = np.random.default_rng(spread)
    entries = r.integers(-spread, spread + 1, (200, 6))
    entries[50:80] = entries[7]
    points = np.concatenate([r.integers(-spread, spread + 1, (500, 6)), entries])
    code, error = codes.Gnat(entries, fanout=5, leaf=4).nearest(points)
    d = ((points[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(2)
    assert error.tolist() == d.min(1).tolist() and code.tolist() == [int(np.flatnonzero(x == x.min())[0]) for x in d]


def test_gnat_eliminates(monkeypatch):
    r = np.random.default_rng(1)
    entries = np.concatenate([r.integers(0, 50, (16, 4)) + 10_000 * k for k in range(16)])
    seen, plain = [], codes.squares
    tree = codes.Gnat(entries)
    monkeypatch.setattr(codes, "squares", lambda p, e: seen.append(len(p) * len(e)) or plain(p, e))
    tree.nearest(entries)
    assert sum(seen) < 256 * 256 / 4


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 31) ** 2 - 1, (1 << 31) ** 2, (1 << 62) - 1])
    assert codes.root_below(n).tolist() == [math.isqrt(x) for x in n.tolist()]
    assert codes.root_above(n).tolist() == [math.isqrt(x - 1) + 1 if x else 0 for x in n.tolist()]


def brute_trie(rows):
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            token = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest() + len(text).to_bytes(4, "big")
            own[c].append(((t is not None, t or 0), token))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:])
    members, below = collections.defaultdict(list), collections.defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    for p in members:
        if p:
            below[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in below[p]) or 1
        saved[p] = sum(saved[q] for q in below[p]) + ((len(members[p]) - 1) * int.from_bytes(p[-1][16:], "big") if p else 0)
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c in members[p] if whole[c] == p))).encode()).hexdigest()
    return sorted(repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(below[p]), leaves[p], saved[p], sha(p))) for p, m in members.items())


def turns(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, part int").repartition(3)


@pytest.fixture(scope="module")
def talk():
    r = random.Random(3)
    out = []
    for c in [*range(60), 100, 101, 250, 251, -5, -100, 10**12]:
        for t in range(r.choice([1, 2, 3, 4, 7, 9])):
            out.append((c, None if r.random() < 0.1 else t, r.choice(["user", None, "a"]) if r.random() < 0.2 else "user", r.choice(["x", "y", "hello wörld", None, "", "z" * 3000])))
    out += [(None, 0, "user", "x"), (7, 1, "user", "x"), (7, 1, "user", "x")]
    # Very many equal conversations, some that they start with and some that go on.
    out += [(c, t, "user", "same") for c in range(300, 399) for t in range(6 + (c % 10 == 0) + (c % 20 == 0))]
    return out + [(c, 0, "user", "same") for c in range(1200, 1230)]


@pytest.mark.parametrize("size", [60, 400, 8 << 20])
def test_prefix_trie(spark, talk, size, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 100)
    got = trie.prefix_trie(turns(spark, talk), partition_bytes=size).collect()
    assert sorted(repr(tuple(x)) for x in got) == brute_trie(talk)


def test_prefix_trie_of_odd_tables(spark):
    assert trie.prefix_trie(turns(spark, [(1, 0, "user", "x")]).limit(0)).count() == 0
    assert trie.prefix_trie(turns(spark, [(None, 0, "user", "x")])).count() == 0
    (root,) = (x for x in trie.prefix_trie(turns(spark, [(5, None, None, None)])).collect() if x.depth == 0)
    assert (root.conv_id, root.parent_conv_id, root.n_convs, root.n_leaves, root.saved_tokens) == (5, None, 1, 1, 0)


def test_extents_against_a_scan():
    r = np.random.default_rng(2)
    for n in (1, 2, 3, 17, 64):
        lcp = np.concatenate([[-1], r.integers(0, 4, n - 1)])
        levels = trie.sparse_table(lcp)
        row, depth = np.repeat(np.arange(n), 5), np.tile(np.arange(5), n)
        right, left = trie.right_extents(levels, row, depth), trie.left_extents(levels, row, depth)
        for i, d, b in zip(row, depth, right, strict=True):
            while i + 1 < n and lcp[i + 1] >= d:
                i += 1
            assert i == b
        for i, d, a in zip(row, depth, left, strict=True):
            while i and lcp[i] >= d:
                i -= 1
            assert i == a
