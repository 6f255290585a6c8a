"""Induced sorting and the removal of repeated bytes against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from marquee.llm import induced_sort as sort, repeated_bytes as rb


def shared(t: bytes, i: int, j: int, cap: int) -> int:
    k = 0
    while k < cap and max(i, j) + k < len(t) and t[i + k] == t[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("room,piece", [(3, 2), (3, 1 << 18), (20, 7), (1_000_000, 1 << 18)])
def test_induced_sort(room, piece, monkeypatch):
    """All places once, in order by the first letters, with what neighbours share: in memory, from files and with strings of names a level down."""
    monkeypatch.setattr(sort, "PIECE", piece)
    r = random.Random(room + piece)
    for _ in range(120):
        letters = r.choice([b"a", b"ab", b"abc", bytes(range(254))])
        t = bytes(r.choice(letters) for _ in range(r.randrange(r.choice([2, 5, 20, 60, 200])))) * r.choice([1, 1, 2, 5])
        cap = r.choice([1, 2, 5, 50])
        blocks = list(sort.InducedSort(np.frombuffer(t, np.uint8), cap, room).descending())
        place, common = ([int(x) for b in blocks for x in b[k]] for k in (0, 1))
        assert sorted(place) == list(range(len(t)))
        for k in range(1, len(t)):
            i, j = place[k - 1], place[k]
            assert t[j : j + cap] <= t[i : i + cap] and common[k] == shared(t, i, j, cap)


def test_queues_keep_order_in_the_file():
    queues, want = sort.Queues(10), {k: [] for k in range(3)}
    for n in range(60):
        part = np.arange(n, n + n % 4)
        queues.push(n % 3, part, part.astype(np.uint8))
        want[n % 3] += part.tolist()
    assert queues.file is not None and queues.held <= 10
    for k in (0, 1):
        got = []
        while (block := queues.pop(k, last=bool(k))) is not None:
            got = [*block[0].tolist(), *got] if k else [*got, *block[0].tolist()]
        assert got == want[k]


def test_equal_windows_have_equal_anchors():
    r = random.Random(4)
    passage = bytes(r.randrange(97, 123) for _ in range(50))
    blobs = [bytes(r.randrange(97, 123) for _ in range(n)) + passage + bytes(r.randrange(97, 123) for _ in range(30)) for n in (0, 1, 40, 77)]
    places = []
    for n, b in zip((0, 1, 40, 77), blobs, strict=True):
        (at,) = rb.anchors(np.frombuffer(b, np.uint8), np.array([n]), 50, 30)
        places.append(at - n)
    assert len(set(places)) == 1 and 0 <= places[0] <= 20


def test_anchors_in_blocks(monkeypatch):
    blob = np.random.default_rng(1).integers(97, 101, 5000).astype(np.uint8)
    starts = np.concatenate([np.arange(0, 700), np.arange(900, 4900)])
    whole = rb.anchors(blob, starts, 50, 30)
    monkeypatch.setattr(rb, "BLOCK", 300)
    assert rb.anchors(blob, starts, 50, 30).tolist() == whole.tolist()


def brute(rows, window=50):
    first: dict[bytes, int] = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            if d is not None:
                first[b[i : i + window]] = min(first.get(b[i : i + window], d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            owner = first.get(b[i : i + window])
            if owner is not None and (d is None or owner < d):
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out.append(repr((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest())))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    words = [f"w{k}" for k in range(500)] + ["é中😀"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages, common = [prose(40) for _ in range(4)], prose(30)
    out = []
    for d in range(150):
        t = prose(r.randrange(60))
        if r.random() < 0.3:
            t += f" {r.choice(passages)} {prose(r.randrange(30))}"
        if r.random() < 0.4:
            t = prose(r.randrange(9)) + common + prose(r.randrange(20))
        if r.random() < 0.2 and out:
            b = r.choice(out)[1] or ""
            k = r.randrange(len(b) + 1)
            t = f"{b[:k]}#{b[k + r.randrange(3):]}"
        if r.random() < 0.1 and out:
            t = r.choice(out)[1]
        out.append((r.choice([d, d, d, d, None, 7]) if d > 20 else d, t))
    out += [(500, None), (501, ""), (502, "a" * 3000), (503, "a" * 70), (3, "a" * 49), (504, "ab" * 400), (-5, "ab" * 30)]
    return out + [((1 << 63) - 1, common + "!"), (-(1 << 63), "q" * 60), (505, "q" * 60), (9, prose(5000))]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "x") for d, t in rows], "doc_id long, text string, chunk long, shard int, kept string").repartition(3)


@pytest.mark.parametrize("chunk,options", [(512 << 10, {}), (2000, {"hot": 1}), (600, {"hot": 3, "room": 1000}), (1000, {"hot": 1000, "shard_text": 1000, "room": 200})])
def test_repeated_bytes(spark, rows, chunk, options, monkeypatch):
    """In one chunk and in many, with and without hot anchors, in memory and from files."""
    monkeypatch.setattr(rb, "CHUNK", chunk)
    got = rb.remove_repeated_bytes(frame(spark, rows), **options)
    assert sorted(repr(tuple(x)) for x in got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()) == brute(rows)
    for x in got.filter("n_spans > 0").collect():
        assert sum(s.end - s.start for s in x.spans) == x.n_removed and hashlib.sha256(x.kept).hexdigest() == x.kept_sha256


def test_repeated_bytes_of_an_empty_table(spark):
    assert rb.remove_repeated_bytes(frame(spark, [(1, "x")]).limit(0)).count() == 0


def test_places_of_hot_parts_are_told_by_chunk_and_not_by_row():
    """3,000 rows of three chunks, against a loop; each chunk's runs come packed, and not a row for each part."""
    import numpy as np
    import pyarrow as pa

    from marquee.llm import repeated_bytes as rb

    r, rows, want = np.random.default_rng(5), [], set()
    for k in range(3000):
        seats, told = np.zeros(int(r.integers(1, 4)), rb._SEAT), np.zeros(int(r.integers(1, 5)), rb._OWNER)
        text = r.integers(0, 30, len(seats))
        seats["text"], seats["start"], seats["doc"] = np.where(r.random(len(seats)) < 0.2, ~text, text), r.integers(0, 5000, len(seats)), r.integers(0, 50, len(seats))
        told["start"], told["doc"] = r.integers(0, 11, len(told)), r.integers(0, 50, len(told))
        rows.append((k % 3, seats.tobytes(), told.tobytes()))
        want |= {(k % 3, t if t >= 0 else ~t, s + x) for t, s, d in seats.tolist() for x, o in told.tolist() if t < 0 or o < d}
    batch = pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], ["chunk", "seats", "told"])
    for pairs in (rb.PAIRS, 7):
        kept, rb.PAIRS = rb.PAIRS, pairs
        out = [x for b in rb._later([batch]) for x in b.to_pylist()]
        rb.PAIRS = kept
        got = [(x["chunk"], t, s) for x in out for t, a, b in np.frombuffer(x["told"], rb._RUN).tolist() for s in range(a, b + 1)]
        assert set(got) == want
        assert pairs < 10 or len(out) == 3 and len(got) == len(want)
