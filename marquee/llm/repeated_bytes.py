"""Substring dedup by suffix arrays: bytes of texts that an earlier document has too go.

A window is ``window`` consecutive bytes of one text.  Sorting all suffixes of the corpus in one order would
need the whole of it in one place, so what may repeat is brought together first, and none is lost:

1.  Chunks.  Texts are packed into chunks of some CHUNK bytes.  Of each window the anchor, ANCHOR bytes at a place that
    the window's bytes alone decide (that of its smallest eight bytes, modulo the number of places), is the same wherever
    the window stands; about one place in fourteen is one.  Texts that are equal as wholes are known by their first document from here on.
2.  Meeting.  32 bits of each chunk's distinct anchors meet in buckets by the others, and each chunk is told which of its own another
    chunk has too, and in which shard: that of the first chunk that has it, so that a copied passage stays in one piece.
    Bits that agree by chance cost work but change nothing.
3.  Segments.  The text around recurring anchors goes to their shards.  The anchors of very many chunks are hot: the text around each of
    these goes in GROUPS parts to shards by what all windows of a part have in common, and equal parts become one before they get there.
4.  Each shard is one text of segments.  External induced sorting (``induced_sort``) puts its suffixes in order with their
    common prefixes; a run of suffixes that share a window's length has one smallest document, and all places of later documents go.
5.  The windows of all shards are joined to the chunks, and the bytes that they cover are cut.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from marquee.llm.common import materialise, mix, texts, written
from marquee.llm.induced_sort import ROOM, SEPARATOR, InducedSort

WINDOW, ANCHOR = 50, 30
#: Bytes of texts in a chunk, and about so many bytes of text for each shard and for each bucket of anchors.
CHUNK, SHARD_TEXT, BUCKET_TEXT = 512 << 10, 16 << 20, 32 << 20
#: An anchor of more chunks is hot; its windows are dealt in so many parts.
HOT, GROUPS = 64, 2
#: Windows of a chunk that are looked at together.
BLOCK = 1 << 22
#: Pairs of a hot part's place and an owner that are looked at together.
PAIRS = 1 << 20
_BITS = 22
_NONE = hashlib.sha256(b"").hexdigest()


def anchors(blob: np.ndarray, starts: np.ndarray, window: int, anchor: int) -> np.ndarray:
    """Places of the anchors of all windows at ``starts`` (ascending)."""
    span = window - 8 + 1  # eight bytes start at so many places of a window
    places = window - anchor + 1
    mark = np.zeros(len(blob), bool)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        upto = int(np.searchsorted(starts, first + BLOCK - window))
        own = starts[at:upto] - first
        part = blob[first : first + int(own[-1]) + window]
        eight = np.ndarray(len(part) - 7, "<u8", np.ascontiguousarray(part), strides=(1,)).astype(np.uint64)
        least = (mix(eight) >> np.uint64(_BITS) << np.uint64(_BITS)) | np.arange(len(eight), dtype=np.uint64)
        size = 1
        while size * 2 <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        low = np.minimum(least[own], least[own + span - size])
        where = (low & np.uint64((1 << _BITS) - 1)).astype(np.int64) - own
        mark[first + own + where % places] = True
        at = upto
    return np.flatnonzero(mark)


def anchor_hashes(blob: np.ndarray, at: np.ndarray, anchor: int) -> np.ndarray:
    """64 bits of the bytes of each anchor, read in words that may overlap."""
    words = np.ndarray(max(len(blob) - 7, 0), "<u8", np.ascontiguousarray(blob), strides=(1,))
    out = np.zeros(len(at), np.uint64)
    for k in [*range(0, anchor - 8, 8), anchor - 8]:
        out = mix((out << np.uint64(1)) + words[at + k] + np.uint64(k + 1))
    return out


def window_starts(sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other where each begins, and all places at which a window starts."""
    begins = np.cumsum(sizes) - sizes
    n = np.maximum(sizes - window + 1, 0)
    return begins, np.repeat(begins - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class Chunk:
    """A chunk's texts, unpacked, with its distinct anchors in the order in which they meet others."""

    def __init__(self, row: dict, window: int, anchor: int, buckets: int):
        self.sizes = np.array(row["sizes"], np.int64)
        self.blob = np.frombuffer(zstandard.decompress(row["blob"], max_output_size=int(self.sizes.sum()) + 1), np.uint8)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.at = np.cumsum(np.frombuffer(zstandard.decompress(row["places"], max_output_size=len(self.blob) * 4 + 4), np.uint32).astype(np.int64))
        self.text = np.searchsorted(self.begins, self.at, "right") - 1 if len(self.at) else self.at
        # Empty texts begin where the next one does; the last that begins there has the bytes.
        self.hash = anchor_hashes(self.blob, self.at, anchor)
        self.bucket = (self.hash % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((self.hash, self.bucket))
        own = self.hash[order]
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        self.group = np.empty(len(own), np.int64)  # of each anchor the number of its hash among the distinct ones
        self.group[order] = np.cumsum(new) - 1
        self.keys, self.key_bucket = own[new], self.bucket[order][new]

    def cuts(self) -> list[tuple[int, int, int]]:
        """(bucket, from, to) of the buckets that have some of the distinct keys."""
        new = np.flatnonzero(np.concatenate([[True], np.diff(self.key_bucket) != 0])) if len(self.keys) else np.empty(0, np.int64)
        return list(zip(self.key_bucket[new].tolist(), new.tolist(), [*new[1:].tolist(), len(self.keys)], strict=False))


def _pack(batches, window: int, anchor: int):
    """Texts as chunks: (chunk, docs, sizes, shas, blob, places), texts and places of anchors compressed."""
    packer = zstandard.ZstdCompressor(3)
    chunk, docs, own, size = TaskContext.get().partitionId() << 32, [], [], 0

    def flush():
        nonlocal chunk, docs, own, size
        sizes = np.array([len(t) for t in own], np.int64)
        blob = b"".join(own)
        at = anchors(np.frombuffer(blob, np.uint8), window_starts(sizes, window)[1], window, anchor)
        row = {
            "chunk": pa.array([chunk], pa.int64()), "docs": pa.array([docs], pa.list_(pa.int64())), "sizes": pa.array([sizes], pa.list_(pa.int64())),
            "shas": pa.array([[hashlib.sha256(t).hexdigest() for t in own]], pa.list_(pa.string())),
            "blob": pa.array([packer.compress(blob)], pa.binary()), "places": pa.array([packer.compress(np.diff(at, prepend=0).astype(np.uint32).tobytes())], pa.binary()),
        }
        chunk, docs, own, size = chunk + 1, [], [], 0
        return pa.RecordBatch.from_pydict(row)

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
            docs.append(doc)
            own.append(text.as_py())
            size += len(own[-1])
            if size >= CHUNK:
                yield flush()
    if own:
        yield flush()


def _meet(batches, shards: int, hot: int):
    """Keys of one bucket (chunk, keys): for each chunk, in the order of its keys, 0 for one that no other has, 1 for a hot one, else 2 + the shard."""
    chunks, keys = [], []
    for batch in batches:
        for row in batch.to_pylist():
            chunks.append((row["bucket"], row["chunk"]))
            keys.append(np.frombuffer(row["keys"], np.uint32))
    if not chunks:
        return
    ids = np.array([c for _, c in chunks])
    owner = np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    flat = np.concatenate(keys)
    rank = np.empty(len(ids), np.int32)
    rank[np.argsort(ids, kind="stable")] = np.arange(len(ids), dtype=np.int32)
    told = np.zeros(len(flat), np.uint32)
    for bucket in {b for b, _ in chunks}:
        mine = np.flatnonzero(np.array([b == bucket for b, _ in chunks])[owner]) if len({b for b, _ in chunks}) > 1 else np.arange(len(flat))
        both = (flat[mine].astype(np.uint64) << np.uint64(32)) | rank[owner[mine]].astype(np.uint64)
        order = np.argsort(both, kind="stable")
        found = flat[mine][order]
        first = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
        n = np.diff(np.append(first, len(found)))
        # Chunks that two keys of 32 bits stand for are counted twice at most, which costs work and changes nothing.
        shard = _shard_of(ids[owner[mine][order][first]], shards) + 2
        code = np.where(n > hot, 1, np.where(n > 1, shard, 0)).astype(np.uint32)
        told[mine[order]] = np.repeat(code, n)
    ends = np.cumsum([len(k) for k in keys])
    packer = zstandard.ZstdCompressor(1)
    for k in range(0, len(chunks), 500):
        own = range(k, min(k + 500, len(chunks)))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array([chunks[i][0] for i in own], pa.int32()), "chunk": pa.array([chunks[i][1] for i in own], pa.int64()), "codes": pa.array([packer.compress(told[ends[i] - len(keys[i]) : ends[i]].tobytes()) for i in own], pa.binary())})


def _shard_of(chunk: np.ndarray, shards: int) -> np.ndarray:
    return (mix(chunk.astype(np.uint64) + np.uint64(1)) % np.uint64(shards)).astype(np.int64)


_SEGMENT = "shard int, bytes binary, chunk long, text int, start int, doc long, hot long, seats binary"
_KINDS = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
#: Where a hot part stands in a chunk: its text (with all bits turned where the document has no id), where it starts, and the document.
_SEAT = np.dtype([("text", np.int32), ("start", np.int32), ("doc", np.int64)])
#: A run of windows that go: their text, and the first and the last place at which one starts.
_RUN = np.dtype([("text", np.int32), ("start", np.int32), ("last", np.int32)])
#: The first document that has a window of a hot part.
_OWNER = np.dtype([("start", np.int32), ("doc", np.int64)])


def _segments(row: dict, chunk: Chunk, codes: np.ndarray, copies: set, window: int, anchor: int, shards: int):
    """Columns of _SEGMENT for a chunk: spans of text around the anchors that recur, and parts of windows of hot ones."""
    code = codes[chunk.group].astype(np.int64)
    # What two texts of this chunk alone have is sorted in the chunk's own shard.
    order = np.lexsort((chunk.text, chunk.group))
    group, text = chunk.group[order], chunk.text[order]
    twice = np.zeros(len(codes), bool)
    twice[group[1:][(group[1:] == group[:-1]) & (text[1:] != text[:-1])]] = True
    code[(code == 0) & twice[chunk.group]] = 2 + int(_shard_of(np.array([row["chunk"]]), shards)[0])
    begins, ends = chunk.begins[chunk.text], (chunk.begins + chunk.sizes)[chunk.text]
    fresh = ~np.isin(chunk.text, np.array(sorted(copies), np.int64))
    back = window - anchor
    data = chunk.blob.tobytes()
    out: list[tuple] = []

    some = np.flatnonzero((code >= 2) & fresh)
    some = some[np.lexsort((chunk.at[some], code[some]))]
    at, low, high = chunk.at[some], np.maximum(chunk.at[some] - back, begins[some]), np.minimum(chunk.at[some] + window, ends[some])
    if len(some):
        new = np.ones(len(some), bool)
        new[1:] = (code[some][1:] != code[some][:-1]) | (chunk.text[some][1:] != chunk.text[some][:-1]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(some)) - 1
        for a, b, t, c in zip(low[first].tolist(), high[last].tolist(), chunk.text[some][first].tolist(), code[some][first].tolist(), strict=True):
            out.append((c - 2, data[a:b], row["chunk"], t, a - int(chunk.begins[t]), row["docs"][t], None, None))
    hot = np.flatnonzero((code == 1) & fresh)
    step = -(-(back + 1) // GROUPS)
    parts: dict[bytes, list] = {}
    for a, t in zip(chunk.at[hot].tolist(), chunk.text[hot].tolist(), strict=True):
        begin, end = int(chunk.begins[t]), int(chunk.begins[t] + chunk.sizes[t])
        for k in range(a - back, a + 1, step):
            to = min(k + step - 1, a)  # starts k .. to; all of their windows have the bytes to .. k + window
            x, y = max(k, begin), min(to, end - window)
            if x <= y:
                part = data[x : y + window]
                seats = parts.get((part, k - a))
                if seats is None:
                    core = xxhash.xxh3_64_intdigest(data[to : k + window], seed=k - a + back)
                    seats = parts[part, k - a] = [core % shards]
                doc = row["docs"][t]
                seats.append((t if doc is not None else ~t, x - begin, doc or 0))
    for (part, _), (shard, *seats) in parts.items():
        docs = [d for t, _, d in seats if t >= 0]
        out.append((shard, part, row["chunk"], None, 0, min(docs, default=None), _signed(xxhash.xxh3_64_intdigest(part, seed=shard)), np.array(seats, _SEAT).tobytes()))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _sort_shard(batches, window: int, room: int):
    """The segments of one shard: (chunk, text, starts, ends) of later documents' windows, and (hot, starts, owners) of each part of hot windows.

    Starts of windows that follow each other are told as a run from a start to an end.
    """
    segments: list[tuple] = []
    starts: list[int] = []
    with tempfile.SpooledTemporaryFile(room) as file:
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("bytes", "chunk", "text", "start", "doc", "hot")), strict=True):
                starts.append(size)
                file.write(row[0] + bytes([SEPARATOR]))
                size += len(row[0]) + 1
                segments.append(row[1:])
        if not segments:
            return
        file.seek(0)
        if size <= room:
            text = np.frombuffer(file.read(), np.uint8)
        else:
            file.flush()
            text = np.memmap(file, np.uint8, "r", shape=(size,))
        begin = np.array(starts + [size])
        # Documents in order; those without an id come last and are equal to each other.
        doc = np.array([s[3] if s[3] is not None else 0 for s in segments], np.int64)
        unnamed = np.array([s[3] is None for s in segments])
        ids = np.unique(doc[~unnamed])
        rank = np.where(unnamed, len(ids), np.searchsorted(ids, doc))
        is_hot = np.array([s[4] is not None for s in segments])
        found, owners = [], []

        def settle(group: np.ndarray, new: np.ndarray):
            """Groups of places whose windows are equal; ``new`` where one begins."""
            own = np.searchsorted(begin, group, "right") - 1
            fits = group + window < begin[own + 1]  # a group's windows lie within their segments, or none does
            first = np.flatnonzero(new)
            least = np.repeat(np.minimum.reduceat(rank[own], first), np.diff(np.append(first, len(group))))
            later = fits & (least < rank[own]) & ~is_hot[own]
            found.append((own[later], group[later]))
            told = fits & is_hot[own] & (least < len(ids))
            owners.append((own[told], group[told], ids[least[told]]))

        held: list[np.ndarray] = []
        for place, common in InducedSort(text, window, room).descending():
            same = common >= window
            # Places of groups of two or more; a group may go on in the next block.
            new = ~same
            if held and new[0]:
                pending = np.concatenate(held)
                if len(pending) > 1 or is_hot[np.searchsorted(begin, pending[0], "right") - 1]:
                    settle(pending, np.arange(len(pending)) == 0)
                held = []
            first = np.flatnonzero(new)
            if not len(first):
                held.append(place)
                continue
            if held:
                held.append(place[: first[0]])
                pending = np.concatenate(held)
                settle(pending, np.arange(len(pending)) == 0)
                held = []
            tail = int(first[-1])
            body = slice(int(first[0]), tail)
            inner, inner_new = place[body], new[body]
            if len(inner):
                alone = inner_new & np.append(inner_new[1:], True)
                keep = ~alone
                if is_hot.any():
                    keep |= is_hot[np.searchsorted(begin, inner, "right") - 1]
                if keep.any():
                    settle(inner[keep], inner_new[keep])
            held = [place[tail:]]
        if held:
            pending = np.concatenate(held)
            if len(pending) > 1 or is_hot.any():
                settle(pending, np.arange(len(pending)) == 0)
    yield from _told(segments, begin, found, owners)


def _told(segments: list[tuple], begin: np.ndarray, found: list, owners: list):
    """The runs of each chunk, and the owners of each hot part."""
    if found:
        own, place = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.argsort(place, kind="stable")
        own, place = own[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (place[1:] != place[:-1] + 1)])[: len(own)])
        last = np.append(first[1:], len(own))[: len(first)] - 1
        of = own[first]
        chunk = np.array([s[0] if s[4] is None else -1 for s in segments], np.int64)[of]
        text, shift = (np.array(x, np.int64)[of] for x in ([s[1] or 0 for s in segments], [s[2] for s in segments]))
        runs = np.zeros(len(of), _RUN)
        runs["text"], runs["start"], runs["last"] = text, place[first] + shift - begin[of], place[last] + shift - begin[of]
        yield from _by(chunk, runs, "chunk")
    if owners:
        own, place, ids = (np.concatenate([o[i] for o in owners]) for i in range(3))
        told = np.zeros(len(own), _OWNER)
        told["start"], told["doc"] = place - begin[own], ids
        yield from _by(np.array([s[4] or 0 for s in segments], np.int64)[own], told, "hot")


_WINDOWS = "chunk long, hot long, told binary"


def _by(key: np.ndarray, values: np.ndarray, name: str):
    """Values of each key, packed; a key may have several rows."""
    order = np.argsort(key, kind="stable")
    key, values = key[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    ends = np.append(first[1:], len(key))[: len(first)]
    for at in range(0, len(first), 1000):
        a, b = first[at : at + 1000], ends[at : at + 1000]
        packed = pa.array([values[x:y].tobytes() for x, y in zip(a, b, strict=True)], pa.binary())
        columns = {"chunk": pa.nulls(len(a), pa.int64()), "hot": pa.nulls(len(a), pa.int64()), "told": packed}
        columns[name] = pa.array(key[a], pa.int64())
        yield pa.RecordBatch.from_pydict(columns)


def _flat(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Packed values of all rows, and how many each has."""
    return np.frombuffer(b"".join(column.to_pylist()), kind), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize


def _later(batches):
    """Seats of hot parts with the owners of their windows: the runs of each seat whose document is later, together for each chunk of a batch."""
    for batch in batches:
        chunk = batch.column("chunk").to_numpy(zero_copy_only=False)
        (seats, n_seats), (told, n_told) = _flat(batch.column("seats"), _SEAT), _flat(batch.column("told"), _OWNER)
        row = np.repeat(np.arange(len(chunk)), n_seats)
        pairs, begin = n_told[row], (np.cumsum(n_told) - n_told)[row]
        ends, at = np.cumsum(pairs), 0
        while at < len(seats):
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] - pairs[at] + PAIRS, "right")))
            n = pairs[at:upto]
            i = np.repeat(np.arange(at, upto), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
            at = upto
            goes = np.flatnonzero((seats["text"][i] < 0) | (told["doc"][j] < seats["doc"][i]))
            if not len(goes):
                continue
            i, j = i[goes], j[goes]
            text, start, of = seats["text"][i], seats["start"][i] + told["start"][j], chunk[row[i]]
            text = np.where(text < 0, ~text, text)
            order = np.lexsort((start, text, of))
            text, start, of = text[order], start[order], of[order]
            new = np.ones(len(of), bool)
            new[1:] = (of[1:] != of[:-1]) | (text[1:] != text[:-1]) | (start[1:] > start[:-1] + 1)
            first = np.flatnonzero(new)
            runs = np.zeros(len(first), _RUN)
            runs["text"], runs["start"], runs["last"] = text[first], start[first], start[np.append(first[1:], len(of)) - 1]
            for packed in _by(of[first], runs, "chunk"):
                yield packed.select(["chunk", "told"])


def _merged(runs: np.ndarray, more: int) -> np.ndarray:
    """Runs in order, those that overlap or touch as one; two touch if ``more`` places or fewer lie between them."""
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs["last"], runs["start"], runs["text"]))]
    # The furthest end so far within the text; a text's runs begin above all those of texts before.
    base = runs["text"].astype(np.int64) << 32
    far = np.maximum.accumulate(base + runs["last"])
    first = np.flatnonzero(np.concatenate([[True], base[1:] + runs["start"][1:] > far[:-1] + 1 + more]))
    out = runs[first].copy()
    out["last"] = (far[np.append(first[1:], len(runs)) - 1] & ((1 << 32) - 1)).astype(np.int32)
    return out


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard_text: int = SHARD_TEXT, room: int = ROOM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans, kept.

    A byte of the UTF-8 text goes if a window that covers it also starts in a document with a smaller doc_id.  spans has the
    removed runs (start, end), and kept the remaining bytes where some go, else null.  Null and empty texts have no
    bytes; texts shorter than a window lose none, and very long ones are a chunk of their own.  Rows that repeat a doc_id never count as
    smaller to each other; a null doc_id counts as larger than any.  An empty table gives none; extra columns are ignored.
    """
    spark = docs.sparkSession
    chunks = written(texts(docs, id_col, text_col).mapInArrow(lambda b: _pack(b, window, anchor), "chunk long, docs array<long>, sizes array<long>, shas array<string>, blob binary, places binary"))
    each = chunks.select("chunk", F.posexplode(F.arrays_zip("docs", "sizes", "shas")).alias("text", "x")).select("chunk", "text", F.col("x.docs").alias("doc"), F.col("x.sizes").alias("size"), F.col("x.shas").alias("sha"))
    n_bytes = int(each.agg(F.sum("size")).first()[0] or 0)
    least = 2 * spark.sparkContext.defaultParallelism
    shards, buckets = max(least, n_bytes // shard_text), max(8, n_bytes // BUCKET_TEXT)
    # Texts that are equal as wholes: all but the first document's go whole, if they have a window.
    long_ = each.filter(F.col("size") >= window)
    same = long_.groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("largest"), F.max(F.col("doc").isNull()).alias("unnamed")).filter("first < largest OR first IS NOT NULL AND unnamed")
    copies = long_.join(same.select("sha", "first"), "sha").filter("doc IS NULL OR doc > first").groupBy("chunk").agg(F.collect_list("text").alias("copies"))
    copies = materialise(copies)

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, window, anchor, buckets)
                parts = chunk.cuts()
                short = (chunk.keys >> np.uint64(32)).astype(np.uint32)
                yield pa.RecordBatch.from_pydict({"bucket": pa.array([b for b, _, _ in parts], pa.int32()), "chunk": pa.array([row["chunk"]] * len(parts), pa.int64()), "keys": pa.array([short[a:b].tobytes() for _, a, b in parts], pa.binary())})

    dealt = chunks.select("chunk", "sizes", "blob", "places").mapInArrow(deal, "bucket int, chunk long, keys binary").repartitionById(buckets, F.col("bucket"))
    met = dealt.mapInArrow(lambda b: _meet(b, shards, hot), "bucket int, chunk long, codes binary")
    told = met.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("bucket", "codes"))).alias("told"))
    told = materialise(told.join(copies, "chunk", "left"))

    def cut_out(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row, window, anchor, buckets)
                codes = np.concatenate([np.frombuffer(zstandard.decompress(t["codes"], max_output_size=4 * len(chunk.keys) + 4), np.uint32) for t in row["told"]])
                out = _segments(row, chunk, codes, set(row["copies"] or ()), window, anchor, shards)
                for at in range(0, len(out), 2000):
                    cols = zip(*out[at : at + 2000], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], [c.split()[0] for c in _SEGMENT.split(", ")])

    segments = written(chunks.select("chunk", "docs", "sizes", "blob", "places").join(told, "chunk").mapInArrow(cut_out, _SEGMENT))
    # Equal parts of hot windows are one, with their smallest document; copies are settled before the shuffle.
    hot_parts = segments.filter("hot IS NOT NULL")
    parts = hot_parts.groupBy("shard", "hot", "bytes").agg(F.min("doc").alias("doc")).select("shard", "bytes", F.lit(None).cast("long").alias("chunk"), F.lit(None).cast("int").alias("text"), F.lit(0).alias("start"), "doc", "hot")
    plain = segments.filter("hot IS NULL").drop("seats").unionByName(parts).repartitionById(shards, F.col("shard"))
    windows = materialise(plain.mapInArrow(lambda b: _sort_shard(b, window, room), _WINDOWS))
    # Places of hot parts are joined by the parts' hashes; Spark splits the tasks of those that very many chunks have.
    later = hot_parts.select("hot", "chunk", "seats").join(windows.filter("hot IS NOT NULL").select("hot", "told"), "hot").mapInArrow(_later, "chunk long, told binary")
    gone = windows.filter("chunk IS NOT NULL").select("chunk", "told").unionByName(later).groupBy("chunk").agg(F.collect_list("told").alias("gone"))
    final = chunks.select("chunk", "docs", "sizes", "shas", "blob").join(gone, "chunk", "left").join(copies, "chunk", "left")
    return final.mapInArrow(lambda b: _cut(b, window), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary")


def _cut(batches, window: int):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    for batch in batches:
        for row in batch.to_pylist():
            whole = np.array([(t, 0, row["sizes"][t] - window) for t in row["copies"] or ()], _RUN)
            runs: dict[int, list] = {}
            for t, a, b in _merged(np.concatenate([whole, *[np.frombuffer(x, _RUN) for x in row["gone"] or ()]]), window - 1).tolist():
                runs.setdefault(t, []).append((a, b + window))
            out, blob, begin = [], None, 0
            for t, (doc, size, sha) in enumerate(zip(row["docs"], row["sizes"], row["shas"], strict=True)):
                if t in runs:
                    if blob is None:
                        blob = zstandard.decompress(row["blob"], max_output_size=sum(row["sizes"]) + 1)
                    spans = runs[t]
                    own, at, kept = blob[begin : begin + size], 0, []
                    for a, b in spans:
                        kept.append(own[at:a])
                        at = b
                    kept = b"".join([*kept, own[at:]])
                    out.append((doc, size, size - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": b} for a, b in spans], kept))
                else:
                    out.append((doc, size, 0, 0, sha, [], None))
                begin += size
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
