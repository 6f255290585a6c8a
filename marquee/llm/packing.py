"""Cost-balanced packing of documents into training sequences.

A task packs its documents window by window.  A window of T tokens gets exactly
ceil(T / capacity) sequences, so less than one sequence of it is padding.  A
document's cost is linear plus quadratic in its tokens (attention stays inside a
document); documents go in descending cost to the sequence of lowest cost that still
has room.  Nothing is shuffled, and memory holds one window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from marquee.llm import tokens
from marquee.llm.common import slices, texts

CAPACITY = 2048
#: Sequences of a window.
WINDOW = 1024
#: Id that ends each document.
END = 1
#: Cost of a token, and of a pair of tokens of one document.
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def assign(lengths: list[int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover all documents, given in descending order.

    Sequences fill gaplessly.  A document longer than a sequence first fills whole ones.  It
    is cut otherwise only if no sequence of the window has room for all of it.
    """
    out, n, parts = [], 0, []
    for k, length in enumerate(lengths):
        at = 0
        while length - at >= capacity:
            out.append((k, at, capacity, n, 0))
            at, n = at + capacity, n + 1
        if at < length:
            parts.append((length - at, k, at))
    parts.sort(key=lambda p: -p[0])
    open_ = -(-sum(p[0] for p in parts) // capacity)
    room, spent = np.full(open_, capacity), np.zeros(open_)
    for length, k, at in parts:
        while length:
            fits = room >= length
            # Where no sequence has room for all of it, the fullest use is made of the one with most room.
            s = int(np.where(fits, spent, np.inf).argmin()) if fits.any() else int(room.argmax())
            now = min(length, int(room[s]))
            out.append((k, at, now, n + s, capacity - int(room[s])))
            room[s] -= now
            spent[s] += cost(now)
            at, length = at + now, length - now
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id alone.  Repeated rows are packed each;
    a null doc_id stays null; an empty table gives no row; extra columns are ignored.  A
    sequence's number is made of its task and its place there, so a task that runs
    again gives the same ones.
    """
    path = path or tokens.default_path()

    def run(batches):
        encoder, base, made = tokens.Encoder(path), TaskContext.get().partitionId() << 40, 0
        held: list[tuple] = []
        size = 0

        def flush():
            nonlocal made, size
            held.sort(key=lambda d: (-len(d[1]), d[0] is None, d[0] or 0))
            lengths = [len(ids) // 4 for _, ids in held]
            rows = assign(lengths, capacity)
            out = {
                "doc_id": pa.array([held[k][0] for k, *_ in rows], pa.int64()),
                "start": pa.array([at for _, at, *_ in rows], pa.int64()),
                "length": pa.array([n for _, _, n, _, _ in rows], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(memoryview(held[k][1])[4 * at : 4 * (at + n)]) for k, at, n, _, _ in rows], pa.int64()),
                "doc_tokens": pa.array([lengths[k] for k, *_ in rows], pa.int64()),
                "sequence_id": pa.array([base + made + s for *_, s, _ in rows], pa.int64()),
                "offset": pa.array([o for *_, o in rows], pa.int64()),
            }
            made += max((s for *_, s, _ in rows), default=-1) + 1
            held.clear()
            size = 0
            return pa.RecordBatch.from_pydict(out)

        for ids, batch in slices(batches):
            for doc, text in zip(ids, batch, strict=True):
                own = encoder.ids(text)
                own.append(END)
                held.append((doc, own.tobytes()))
                size += len(own)
                if size >= window * capacity:
                    yield flush()
        if held:
            yield flush()

    return texts(docs, id_col, text_col).mapInArrow(run, SCHEMA)
