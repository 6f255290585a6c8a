"""Substring dedup by repeated-phrase automata.

A window is ``window`` consecutive words.  What recurs is found and removed in four steps:

1.  Confirmed passages.  Of each window the phrase of ``anchor`` words with the smallest hash is
    its anchor, so equal windows have equal anchors; about one phrase in eighteen is one.
    Anchors of two documents or more recur.  Texts that are equal word by word are
    represented by their smallest doc_id from here on.
2.  Automata.  The recurring phrases are dealt to shards by the document that has them first,
    so that a copied passage is in one shard, and each shard's phrases are compiled into
    one Aho-Corasick automaton over words, of some SHARD_PHRASES phrases.
3.  Occurrences.  Texts are cut into chunks of CHUNK window starts, and each chunk is streamed through the
    automata of the shards that have any of its anchors; what is found there, word for
    word, is all that is known of places.  A shard that very many chunks visit is
    copied, one automaton for each SLICE chunks.
4.  Windows whose anchor the automaton found are compared as wholes by 64-bit hashes: the
    smallest document of each is its owner, and the words of every later window go.
"""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from marquee.llm.common import WordHashes, materialise, slices, texts, window_hashes, written

WINDOW, ANCHOR = 50, 15
#: Window starts of a chunk; chunks of a document whose phrases go to one shard.
CHUNK, TOGETHER = 512, 16
#: Phrases of a shard, about; chunks that one copy of its automaton streams.
SHARD_PHRASES, SLICE = 5_000, 1_024
_LAST = (1 << 63) - 1
_NOTHING = hashlib.sha256(b"").hexdigest()


def anchors(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each window the place and the hash of its anchor, the last of equal ones."""
    phrases = window_hashes(words, anchor)
    span = window - anchor + 1
    if len(phrases) < span:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    seen = sliding_window_view(phrases[::-1], span)
    at = (len(phrases) - 1 - (np.arange(len(seen)) + seen.argmin(1)))[::-1]
    return at, phrases[at]


class Phrases:
    """An Aho-Corasick automaton whose letters are words."""

    def __init__(self, phrases: list[list[bytes]]):
        self.numbers: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH, ahocorasick.KEY_SEQUENCE)
        for phrase in phrases:
            self.automaton.add_word(tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in phrase))
        if phrases:
            self.automaton.make_automaton()

    def places(self, words: list[bytes]) -> np.ndarray:
        """Word places at which any of the phrases starts."""
        if not self.numbers or not words:
            return np.empty(0, np.int64)
        number = self.numbers.get
        return np.fromiter((end - n + 1 for end, n in self.automaton.iter(tuple(number(w, 0) for w in words))), np.int64)


def located(words: list[bytes], own: np.ndarray, phrases: Phrases, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows whose anchors the automaton finds; ``own`` has the words' hashes."""
    found = np.zeros(len(words) + 1, bool)
    found[phrases.places(words)] = True
    starts = np.flatnonzero(found[anchors(own, window, anchor)[0]])
    return starts, window_hashes(own, window)[starts]


def stream(batches, window: int, anchor: int):
    """Chunks ordered by shard and slice, those that give phrases first: (doc, h, start, windows) of each that has some."""
    hashes, unit, given, waiting, phrases = WordHashes(), None, [], [], None
    out: list[tuple] = []

    def take(doc, h, first, words, own):
        starts, hit = located(words, own, phrases, window, anchor)
        if len(starts):
            out.append((doc, h, (starts + first).astype(np.int32), hit.view(np.int64)))

    def close():
        """Compiles what a unit has given and streams the chunks that waited for it."""
        nonlocal phrases
        if phrases is None:
            phrases = Phrases(given)
            for x in waiting:
                take(*x)
            given.clear()
            waiting.clear()

    def batch_of():
        cols = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_pydict({"doc": pa.array(cols[0], pa.int64()), "h": pa.array(cols[1], pa.int64()), "starts": pa.array(cols[2], pa.list_(pa.int32())), "windows": pa.array(cols[3], pa.list_(pa.int64()))})

    columns = ("shard", "slice", "doc", "h", "first", "mine", "streamed", "text")
    for rows in slices(batches, columns):
        for shard, part, doc, h, first, mine, streamed, text in zip(*rows, strict=True):
            if (shard, part) != unit:
                close()
                unit, phrases = (shard, part), None
            words = text.encode().split(b" ")
            own = hashes.of(words)
            if mine:
                at, of = anchors(own, window, anchor)
                _, once = np.unique(of, return_index=True)
                wanted = np.isin(of[once], np.array(mine, np.int64).view(np.uint64))
                given.extend(words[p : p + anchor] for p in at[once][wanted].tolist())
            else:
                close()
            if streamed and phrases is None:
                waiting.append((doc, h, first, words, own))
            elif streamed:
                take(doc, h, first, words, own)
        if len(out) >= 500:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, shard_phrases: int = SHARD_PHRASES, chunk: int = CHUNK, slice_: int = SLICE) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window of the input that covers it also starts in a document with a
    smaller doc_id.  kept_text is null where nothing goes (the text stands as it is) and
    the kept words joined by spaces elsewhere.  Null, empty and blank texts have no words;
    texts shorter than a window lose none.  Rows that repeat a doc_id never count as
    smaller to each other; a null doc_id counts as larger than any.  An empty table gives
    none; extra columns are ignored.
    """
    last, rows = F.lit(_LAST), texts(docs, id_col, text_col)
    shifted, back = _free_last(rows)
    held = rows.select(F.coalesce(shifted, last).alias("doc"), F.xxhash64("text").alias("h"), "text")

    def describe(batches):
        hashes = WordHashes()
        for ids, rows, hs in slices(batches, ("doc", "text", "h")):
            split = [t.encode().split() for t in rows]
            chunks, own = [], []
            for words in split:
                of = anchors(hashes.of(words), window, anchor)[1]
                # Neighbouring windows mostly share their anchor, so few are left to sort.
                parts = [np.unique(part[np.diff(part, prepend=~part[:1]) != 0]) for part in (of[k : k + chunk] for k in range(0, len(of), chunk))]
                chunks.append(np.repeat(np.arange(len(parts), dtype=np.int32), [len(x) for x in parts]))
                own.append(np.concatenate([np.empty(0, np.uint64), *parts]).view(np.int64))
            yield pa.RecordBatch.from_pydict({"doc": pa.array(ids, pa.int64()), "h": pa.array(hs, pa.int64()), "n_words": pa.array(map(len, split), pa.int64()), "sha": pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for w in split], pa.string()), "chunk": pa.array(chunks, pa.list_(pa.int32())), "a": pa.array(own, pa.list_(pa.int64()))})

    table = materialise(held.mapInArrow(describe, "doc long, h long, n_words long, sha string, chunk array<int>, a array<long>"))
    # Texts are known by doc and h (those of a doc whose hashes collide would share their places); doc says which is smaller.
    copies = table.filter(F.col("n_words") >= window).groupBy("sha").agg(F.min("doc").alias("first"), F.max("doc").alias("largest")).filter("first <> largest")
    copies = materialise(copies.select("sha", "first"))
    ranked = materialise(table.join(copies, "sha", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc"), F.lit(False))).drop("first"))
    each = ranked.filter("NOT copy").select("doc", "h", F.explode(F.arrays_zip("chunk", "a")).alias("x")).select("doc", "h", "x.chunk", "x.a")
    recurring = each.groupBy("a").agg(F.min(F.struct("doc", "h", "chunk")).alias("of"), F.max("doc").alias("largest")).filter("of.doc <> largest").select("a", "of")
    recurring = materialise(recurring)
    shards = -(-recurring.count() // shard_phrases) or 1
    shard = F.pmod(F.xxhash64("of.doc", "of.h", F.floor(F.col("of.chunk") / TOGETHER)), F.lit(shards)).alias("shard")
    mine = F.when((F.col("of.doc") == F.col("doc")) & (F.col("of.h") == F.col("h")) & (F.col("of.chunk") == F.col("chunk")), F.col("a"))
    visits = each.join(recurring, "a").select("doc", "h", "chunk", shard, mine.alias("mine"))
    visits = materialise(visits.groupBy("doc", "h", "chunk", "shard").agg(F.collect_set("mine").alias("mine")))
    parts = materialise(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / slice_).cast("int").alias("slices")))
    seats = visits.join(parts, "shard").groupBy("doc", "h").agg(F.collect_list(F.struct("chunk", "shard", "slices", "mine")).alias("seats"))

    def deal(batches):
        """Chunks of texts to slices of shards; what has phrases of a shard goes to all of its slices and is streamed in one."""
        for ids, hs, rows, all_seats in slices(batches, ("doc", "h", "text", "seats")):
            out: list[tuple] = []
            for doc, h, text, own in zip(ids, hs, rows, all_seats, strict=True):
                words = text.encode().split()
                for seat in own:
                    first = seat["chunk"] * chunk
                    piece = b" ".join(words[first : first + chunk + window - 1]).decode()
                    home = (h + seat["chunk"]) % seat["slices"]
                    for part in range(seat["slices"]) if seat["mine"] else (home,):
                        out.append((seat["shard"], part, doc, h, first, seat["mine"], part == home, piece))
                        if len(out) >= 1000:
                            yield _seated(out)
                            out = []
            if out:
                yield _seated(out)

    dealt = held.join(seats, ["doc", "h"]).mapInArrow(deal, "shard long, slice int, doc long, h long, first int, mine array<long>, streamed boolean, text string")
    ordered = dealt.repartition("shard", "slice").sortWithinPartitions("shard", "slice", F.size("mine") == 0)
    found = written(ordered.mapInArrow(lambda batches: stream(batches, window, anchor), "doc long, h long, starts array<int>, windows array<long>"))
    windows = found.select("doc", "h", F.explode(F.arrays_zip("starts", "windows")).alias("w")).select("doc", "h", F.col("w.starts").alias("start"), F.col("w.windows").alias("window"))
    owners = windows.groupBy("window").agg(F.min("doc").alias("owner"), F.max("doc").alias("largest")).filter("owner <> largest").select("window", "owner")
    # Both sides of this join come straight from a shuffle, so Spark splits the tasks of windows that very many texts share.
    later = windows.join(materialise(owners), "window").filter("owner < doc")
    gone = later.groupBy("doc", "h").agg(F.collect_set("start").alias("gone"))

    def cut(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                words = row["text"].encode().split()
                edge = np.zeros(len(words) + 1, np.int64)
                starts = np.array(row["gone"])
                np.add.at(edge, starts, 1)
                np.add.at(edge, starts + window, -1)
                dropped = np.cumsum(edge)[:-1] > 0
                kept = b" ".join(w for w, d in zip(words, dropped.tolist(), strict=True) if not d)
                out.append((row["doc"], row["h"], int(dropped.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_pydict({"doc": pa.array(cols[0], pa.int64()), "h": pa.array(cols[1], pa.int64()), "n_removed": pa.array(cols[2], pa.int64()), "kept": pa.array(cols[3], pa.string()), "kept_text": pa.array(cols[4], pa.string())})

    changed = held.join(gone, ["doc", "h"]).mapInArrow(cut, "doc long, h long, n_removed long, kept string, kept_text string")
    changed = changed.groupBy("doc", "h").agg(F.first(F.struct("n_removed", "kept", "kept_text")).alias("x"))  # of repeated rows one
    changed = written(changed.select("doc", "h", "x.*"))
    return ranked.drop("chunk", "a").join(changed, ["doc", "h"], "left").select(
        F.when(F.col("doc") != last, back).alias("doc_id"),
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_NOTHING)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )


def _free_last(rows: DataFrame) -> tuple[Column, Column]:
    """Ids in their order without the largest one, which stands for null; and the ids of old.

    Where that id is one of the rows', all ids above the last unused one become one less.
    """
    doc, held = F.col("doc_id"), F.col("doc")
    if (rows.agg(F.max("doc_id")).first()[0] or 0) < _LAST:
        return doc, held
    ids = rows.select("doc_id").filter("doc_id IS NOT NULL").distinct()
    below = ids.filter(doc > -_LAST - 1).select((doc - 1).alias("doc_id"))
    gap = below.join(ids, "doc_id", "left_anti").agg(F.max("doc_id")).first()[0]
    return F.when(doc > gap, doc - 1).otherwise(doc), F.when(held >= gap, held + 1).otherwise(held)


def _seated(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), pa.string())
    names = ["shard", "slice", "doc", "h", "first", "mine", "streamed", "text"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
