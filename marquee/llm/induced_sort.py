"""External induced sorting: the suffixes of a shard in order, with the prefixes that neighbours have in common.

1.  A place whose suffix is smaller than the next one is S, else L; an S after an L is a seed.
    The text from one seed to the next is named by rank; a string of names is sorted in memory by doubling where it fits, and
    is sorted by this very method, one level down, where it does not.
2.  The sorted seeds induce all L suffixes: the suffixes are taken in ascending order, and the place before each, if it is L, goes to the
    queue of its letter.  Then all S suffixes are induced from those in descending order.
3.  The queues are one monotone priority queue: keys never fall while they are popped (or never rise), so a list of blocks
    for each letter, first in first out, is in order.  Its tuples are a place and the length of the
    prefix in common with the tuple before it; that of an induced tuple is one more than the minimum over what has been scanned
    since its letter was last induced.  Beyond ``room`` tuples in memory the fullest queues go to a file.

Lengths count up to ``cap``, and suffixes that agree in so many letters are in any order, so passages that
many texts share cost no more than others.

The text and its types are mapped from files where they have over ``room`` bytes.  All files are nameless and belong to one
task, as Spark's own spills do: nothing reads them but that task, and they go with its process.
"""

from __future__ import annotations

import collections
import tempfile

import numpy as np

#: Tuples of a queue in memory, and of a block that is scanned at once.
ROOM, PIECE = 8_000_000, 1 << 18
#: Separates segments; UTF-8 has no such byte.
SEPARATOR = 0xFE
_FAR = 255


def mapped(array: np.ndarray, room: int) -> np.ndarray:
    """The array, in a file if it has over ``room`` bytes."""
    if array.nbytes <= room:
        return array
    with tempfile.TemporaryFile() as file:
        file.write(memoryview(np.ascontiguousarray(array)).cast("B"))
        file.flush()
        return np.memmap(file, array.dtype, "r+", shape=array.shape)


class Queues:
    """Tuples (place, common) by key in blocks; the fullest keys are written to a file beyond ``room`` tuples."""

    def __init__(self, room: int):
        self.room, self.held, self.file, self.end = room, 0, None, 0
        self.blocks: dict[int, collections.deque] = collections.defaultdict(collections.deque)
        self.inside: collections.Counter = collections.Counter()

    def push(self, key: int, place: np.ndarray, common: np.ndarray) -> None:
        self.blocks[key].append((place, common))
        self.inside[key] += len(place)
        self.held += len(place)
        if self.held > self.room:
            self._spill()

    def _spill(self) -> None:
        self.file = self.file or tempfile.TemporaryFile()
        for key, n in self.inside.most_common():
            if self.held <= self.room // 2:
                break
            place, common = self._joined([b for b in self.blocks[key] if len(b) == 2])
            # Blocks in the file are older than those in memory.
            self.blocks[key] = collections.deque([b for b in self.blocks[key] if len(b) == 3])
            self.file.seek(self.end)
            for at in range(0, n, PIECE):
                part = (place[at : at + PIECE], common[at : at + PIECE])
                for x in part:
                    self.file.write(x.tobytes())
                self.blocks[key].append((self.end, len(part[0]), place.dtype))
                self.end += sum(x.nbytes for x in part)
            self.held -= n
            del self.inside[key]

    @staticmethod
    def _joined(blocks: list) -> tuple[np.ndarray, np.ndarray]:
        return blocks[0] if len(blocks) == 1 else tuple(np.concatenate([b[k] for b in blocks]) for k in (0, 1))

    def pop(self, key: int, last: bool = False) -> tuple[np.ndarray, np.ndarray] | None:
        """Some PIECE tuples from the front, or from the end; None if there are none."""
        own, out, n = self.blocks.get(key), [], 0
        while own and n < PIECE:
            block = own.pop() if last else own.popleft()
            if len(block) == 3:
                start, size, kind = block
                self.file.seek(start)
                raw = self.file.read(size * (kind.itemsize + 1))
                block = np.frombuffer(raw, kind, size), np.frombuffer(raw, np.uint8, size, size * kind.itemsize)
            else:
                self.held -= len(block[0])
                self.inside[key] -= len(block[0])
            out.append(block)
            n += len(block[0])
        return self._joined(out[::-1] if last else out) if out else None


def range_min(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The minimum of each interval, ends included, of bytes: two spans of a power of two cover it."""
    out = np.empty(len(left), np.uint8)
    level = np.frexp((right - left + 1).astype(np.float64))[1] - 1
    table, k = values, 0
    top = int(level.max(initial=-1))
    while k <= top:
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = np.minimum(table[left[at]], table[right[at] - (1 << k) + 1])
        k += 1
        if k <= top:
            table = np.minimum(table[: -(1 << (k - 1))], table[1 << (k - 1) :])
    return out


def smaller_than_next(text: np.ndarray, room: int) -> np.ndarray:
    """For each place if its suffix is S; the last is L, as nothing is smaller than any letter."""
    out = mapped(np.zeros(len(text), bool), room)
    below, after = None, False
    for end in range(len(text), 0, -PIECE):
        start = max(0, end - PIECE)
        part = np.asarray(text[start:end])
        more = part if below is None else np.append(part, below)
        rising, falling = np.zeros(len(part), bool), np.zeros(len(part), bool)
        rising[: len(more) - 1], falling[: len(more) - 1] = more[:-1] < more[1:], more[:-1] > more[1:]
        # Of a run of one letter all have the type of its last.
        settled = np.flatnonzero(rising | falling)
        at = np.searchsorted(settled, np.arange(len(part)))
        own = np.append(rising[settled], after)
        out[start:end] = own[at]
        below, after = part[0], bool(own[at[0]])
    return out


def run_lengths(text: np.ndarray, places: np.ndarray, cap: int) -> np.ndarray:
    """How often the letter of each place is repeated from there on, up to ``cap``."""
    letter, out, open_ = text[places], np.ones(len(places), np.int64), np.arange(len(places))
    for k in range(1, cap):
        inside = places[open_] + k < len(text)
        open_ = open_[inside]
        open_ = open_[text[places[open_] + k] == letter[open_]]
        if not len(open_):
            break
        out[open_] += 1
    return np.minimum(out, cap)


def _ranked(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order by some keys, the first before the others, and if each row in order differs from the one before."""
    keys = [k for k in keys if len(k) and k.min() != k.max()] or keys[:1]
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in (k[order] for k in keys)], axis=0)
    return order, new


def named(text: np.ndarray, seeds: np.ndarray, wide: bool) -> np.ndarray:
    """The rank of the text from each seed to the next, both included; one that another starts with is the larger.

    ``wide``: the letters are names of the level above, and are compared one by one.
    """
    ends = np.append(seeds[1:] + 1, len(text))
    if not len(seeds):
        return np.empty(0, np.int64)
    # Behind a seed's text stands what is larger than any letter, behind the whole what is smaller.
    above = 2 + (int(text.max()) if wide else 255)
    step, bits = (1, 0) if wide else (7, 9)

    def word(places, ends):
        out = np.zeros(len(places), np.int64)
        for k in range(step):
            at = places + k
            letter = np.where(at < ends, text[np.minimum(at, len(text) - 1)].astype(np.int64) + 1, np.where(ends == len(text), 0, above))
            out = (out << bits) | letter
        return out

    rank, at = np.zeros(len(seeds), np.int64), 0
    active = np.arange(len(seeds))
    while len(active):
        # Only what is still equal to another and goes on is compared further.
        order, new = _ranked([rank[active], word(seeds[active] + at, ends[active])])
        own = active[order]
        group = np.cumsum(new) - 1
        base = np.concatenate([[True], rank[own][1:] != rank[own][:-1]])
        first = np.flatnonzero(new)
        start = np.maximum.accumulate(np.where(base, np.arange(len(own)), 0))
        rank[own] = rank[own] + (first[group] - start)
        size = np.diff(np.append(first, len(own)))[group]
        at += step
        active = own[(size > 1) & (seeds[own] + at < ends[own])]
    return np.unique(rank, return_inverse=True)[1]


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of a string of names by ``depth`` names at least; behind its end stands what is smallest."""
    rank, reach = names.astype(np.int64) + 1, 1
    while True:
        behind = np.zeros(len(rank), np.int64)
        behind[: len(rank) - reach] = rank[reach:]
        both = (rank << 32) | behind
        order = np.argsort(both)  # equal ones may come in any order
        if 2 * reach >= depth:
            return order
        new = np.concatenate([[1], (np.diff(both[order]) != 0).astype(np.int64)])
        rank = np.empty(len(names), np.int64)
        rank[order] = np.cumsum(new)
        if new.all():
            return order
        reach *= 2


def common_prefixes(text: np.ndarray, places: np.ndarray, cap: int, room: int = ROOM) -> np.ndarray:
    """What each place's suffix has in common with that of the place before it, up to ``cap``; the first has 0."""
    out = np.zeros(len(places), np.int64)
    active = np.arange(1, len(places))
    padded = mapped(np.concatenate([text, np.zeros(8, np.uint8)]), room)
    words = np.ndarray(len(text) + 1, ">u8", padded, strides=(1,))  # the eight letters from each place on
    for at in range(0, cap, 8):
        a, b = np.minimum(places[active] + at, len(text)), np.minimum(places[active - 1] + at, len(text))
        x = words[a].astype(np.uint64) ^ words[b].astype(np.uint64)
        equal = np.full(len(active), 8)
        for k in range(7, -1, -1):
            equal[(x >> np.uint64(8 * (7 - k))) != 0] = k
        # Behind the text stands nothing that could be equal.
        out[active] += np.minimum(equal, np.maximum(len(text) - np.maximum(a, b), 0))
        active = active[equal == 8]
        if not len(active):
            break
    return np.minimum(out, cap).astype(np.uint8)


class InducedSort:
    """Suffixes of ``text`` in descending order, as blocks (places, common): common counts the letters shared with the suffix before.

    Neighbours are in order by ``cap`` letters at least.  ``room`` bounds the tuples in memory.
    """

    def __init__(self, text: np.ndarray, cap: int, room: int = ROOM, wide: bool = False):
        self.cap, self.room, self.wide = cap, room, wide
        self.text = mapped(text, room)
        self.rising = smaller_than_next(self.text, room)
        self.letters = int(self.text.max(initial=0)) + 1
        self.since = np.full(0 if wide else self.letters, _FAR, np.uint8)

    def seeds(self) -> np.ndarray:
        found = [np.flatnonzero(self.rising[max(a, 1) : a + PIECE] & ~self.rising[max(a, 1) - 1 : a + PIECE - 1][: len(self.rising[max(a, 1) : a + PIECE])]) + max(a, 1) for a in range(0, len(self.text), PIECE)]
        return np.concatenate([np.empty(0, np.int64), *found])

    def sorted_seeds(self) -> np.ndarray:
        seeds = self.seeds()
        names = named(self.text, seeds, self.wide)
        # Two letters or more lie between seeds, so half as many names reach as far.
        depth = -(-self.cap // 2)
        if len(names) <= self.room or len(names) < 4:
            return seeds[doubled(names, depth)] if len(names) else seeds
        below = InducedSort(names, depth, self.room, wide=True)
        return seeds[np.concatenate([p for p, _ in below.descending()])[::-1]]

    def _induce(self, queues: Queues, place: np.ndarray, common: np.ndarray, rising: bool) -> None:
        """The place before each scanned one goes to the queue of its letter if it has the type."""
        at = np.flatnonzero(place > 0)
        before = place[at] - 1
        fits = self.rising[before] == rising
        at, before = at[fits], before[fits]
        letter = self.text[before]
        order = np.argsort(letter, kind="stable")
        at, before, letter = at[order], before[order], letter[order]
        new = np.flatnonzero(np.concatenate([[True], letter[1:] != letter[:-1]])) if len(letter) else np.empty(0, np.int64)
        keys, ends = letter[new].astype(np.int64), np.append(new[1:], len(letter))[: len(new)]
        found = np.zeros(len(at), np.uint8)
        if not self.wide:
            if len(at):
                left = np.concatenate([[0], at[:-1] + 1])
                left[new] = 0
                least = range_min(common, left, at)
                least[new] = np.minimum(least[new], self.since[keys])
                found = np.minimum(least.astype(np.int64) + 1, self.cap).astype(np.uint8)
            self.since = np.minimum(self.since, common.min())
            if len(at):
                last = at[ends - 1]
                tail = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(_FAR))
                self.since[keys] = tail[last + 1]
        for key, a, b in zip(keys.tolist(), new.tolist(), ends.tolist(), strict=True):
            queues.push(key, before[a:b], found[a:b])

    def _seam(self, a: int, b: int) -> int:
        return int(run_lengths(self.text, np.array([a, b]), self.cap).min()) if not self.wide else 0

    def descending(self):
        text, n = self.text, len(self.text)
        if not n:
            return
        seeds = self.sorted_seeds()
        shared = np.zeros(len(seeds), np.uint8) if self.wide else common_prefixes(text, seeds, self.cap, self.room)
        cuts = np.searchsorted(text[seeds], np.arange(self.letters + 1))
        falling, done = Queues(self.room), Queues(self.room)
        falling.push(int(text[n - 1]), np.array([n - 1]), np.zeros(1, np.uint8))
        for key in range(self.letters):
            last = None
            while (block := falling.pop(key)) is not None:
                place, common = block
                if last is None:
                    common = np.concatenate([np.zeros(1, np.uint8), common[1:]])
                done.push(key, place, common)
                self._induce(falling, place, common, False)
                last = int(place[-1])
            for a in range(cuts[key], cuts[key + 1], PIECE):
                b = min(a + PIECE, cuts[key + 1])
                common = shared[a:b].copy()
                if a == cuts[key]:
                    common[0] = 0 if last is None else self._seam(last, int(seeds[a]))
                self._induce(falling, seeds[a:b], common, False)
        self.since[:] = _FAR
        rising = Queues(self.room)
        for key in reversed(range(self.letters)):
            last = None
            while (block := rising.pop(key)) is not None:
                place, common = block
                if last is None:
                    common = np.concatenate([np.zeros(1, np.uint8), common[1:]])
                yield place, common
                self._induce(rising, place, common, True)
                last = int(place[-1])
            carried = None
            while (block := done.pop(key, last=True)) is not None:
                place, own = block[0][::-1], block[1][::-1]
                if carried is None:
                    carried = 0 if last is None else self._seam(last, int(place[0]))
                common = np.concatenate([np.array([carried], np.uint8), own[:-1]])
                yield place, common
                self._induce(rising, place, common, True)
                carried = int(own[-1])
