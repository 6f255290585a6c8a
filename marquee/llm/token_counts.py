"""Token counts by the whole-token shortcut.

Once, on the driver, every vocabulary string is encoded alone; those that come back
as one token are proven whole.  Tasks cut texts into pre-tokens and count each proven
one as a token; only other pre-tokens are merged, once each as long as a bounded memory
of them holds.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from marquee.llm import tokens
from marquee.llm.common import slices, texts

LIMIT = 512
#: Merged pre-tokens that a task remembers at most, and how many it merges in one call.
REMEMBERED, TOGETHER = 400_000, 5_000
#: Texts are cut together up to this many characters.
CHARS = 1_500_000


class PieceCounts:
    def __init__(self, path: str, whole: list[str]):
        self.encode = tokens.tokenizer(path).encode_batch
        self.whole, self.known = dict.fromkeys(whole, 1), dict.fromkeys(whole, 1)
        self.specials, self.cut = tokens.specials(path)

    def learn(self, seen: list[list[str]]) -> None:
        if len(self.known) > REMEMBERED + len(self.whole):
            self.known = dict(self.whole)
        new = sorted(set().union(*seen) - self.known.keys())
        for at in range(0, len(new), TOGETHER):
            part = new[at : at + TOGETHER]
            self.known.update(zip(part, map(len, self.encode(part, add_special_tokens=False)), strict=True))

    def counts(self, batch: list[str]) -> list[int]:
        extra, cut = [0] * len(batch), []
        for k, text in enumerate(batch):
            if self.cut is not None and self.cut.search(text):
                parts = self.cut.split(text)
                extra[k] = len(parts) // 2
                cut.append([p for part in parts[::2] for p in tokens.pieces(part)])
            else:
                cut.append(tokens.pieces(text))
        self.learn(cut)
        of = self.known.__getitem__
        return [sum(map(of, words), n) for words, n in zip(cut, extra, strict=True)]


class WholeTextCounts:
    """For tokenizers whose pre-tokens are not those of byte-level BPE: each text is encoded."""

    def __init__(self, path: str):
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self.encode = lambda batch: model.encode(batch, num_threads=1)
        else:
            self.encode = lambda batch: tokens.tokenizer(path).encode_batch(batch, add_special_tokens=False)

    def counts(self, batch: list[str]) -> list[int]:
        return list(map(len, self.encode(batch)))


def grouped(ids: list, batch: list[str]):
    """Runs of texts of some CHARS together; a longer text stands alone."""
    start, chars = 0, 0
    for end, text in enumerate(batch, 1):
        chars += len(text)
        if chars >= CHARS or end == len(batch):
            yield ids[start:end], batch[start:end]
            start, chars = end, 0


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    ``path`` is a tokenizer file, .json or .model.  Null and empty texts have 0 tokens and
    bytes; a special string inside a text is one token where the library takes it so.
    Repeated rows and null ids are counted like any row; an empty table gives none; extra
    columns are ignored.  Texts are never cut short.
    """
    path = path or tokens.default_path()
    whole = tokens.whole_tokens(path) if path.endswith(".json") and tokens.is_byte_level(path) else None
    shared = docs.sparkSession.sparkContext.broadcast(whole)  # at most the vocabulary

    def count(batches):
        counter = WholeTextCounts(path) if shared.value is None else PieceCounts(path, shared.value)
        for ids, batch in slices(batches):
            for some, part in grouped(ids, batch):
                n = counter.counts(part)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(some, pa.int64()),
                        "n_bytes": pa.array([len(t.encode()) for t in part], pa.int64()),
                        "n_tokens": pa.array(n, pa.int64()),
                        "over_limit": pa.array([x > limit for x in n], pa.bool_()),
                    }
                )

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
