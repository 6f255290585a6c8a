"""Tokenizer files in tasks.  The files belong to the installation and are found by path on every machine."""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from functools import lru_cache

import regex

#: Where byte-level BPE cuts a text before it merges (the pattern of the public vocabulary).
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallelism
    return Tokenizer.from_file(path)


@lru_cache(maxsize=4)
def _layout(path: str) -> tuple[dict[str, int], bool]:
    """From the file alone, so that a worker that merges by ranks never loads the tokenizer: its added tokens; if it cuts as PIECES does."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    kind = made["pre_tokenizer"] or {}
    plain = kind.get("type") == "ByteLevel" and kind.get("use_regex", True) and not kind.get("add_prefix_space") and not made["normalizer"]
    return {t["content"]: t["id"] for t in made["added_tokens"]}, bool(plain)


@lru_cache(maxsize=4)
def specials(path: str) -> tuple[dict[str, int], re.Pattern | None]:
    """Strings that the tokenizer takes whole wherever they stand in a text."""
    found = _layout(path)[0]
    return found, re.compile("(" + "|".join(map(re.escape, sorted(found, key=len, reverse=True))) + ")") if found else None


def is_byte_level(path: str) -> bool:
    return _layout(path)[1]


@lru_cache(maxsize=4)
def _ranks(path: str):
    """The same vocabulary as merge ranks, if it lies beside the file: tiktoken merges it several times faster."""
    beside = os.path.splitext(path)[0] + ".tiktoken"
    if not (os.path.exists(beside) and is_byte_level(path)):
        return None
    import tiktoken

    with open(beside, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of a text as ``tokenizers`` gives them without added special tokens."""

    def __init__(self, path: str):
        self.specials, self.cut = specials(path)
        ranks = _ranks(path)
        self.plain = ranks.encode_ordinary if ranks else lambda text: tokenizer(path).encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> array:
        if self.cut is None or not self.cut.search(text):
            return array("I", self.plain(text))
        out = array("I")
        for part in self.cut.split(text):
            out.extend([self.specials[part]] if part in self.specials else self.plain(part))
        return out


def whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that alone encode as exactly their own token; at most as many as the vocabulary has."""
    t = tokenizer(path)
    taken, _ = specials(path)
    ids = [i for i in t.get_vocab().values() if i is not None]
    named = [(i, s) for i, s in zip(ids, t.decode_batch([[i] for i in ids], skip_special_tokens=False), strict=True) if s and "�" not in s and s not in taken]
    proofs = t.encode_batch([s for _, s in named], add_special_tokens=False)
    return [s for (i, s), proof in zip(named, proofs, strict=True) if proof.ids == [i]]


pieces = regex.compile(PIECES).findall
