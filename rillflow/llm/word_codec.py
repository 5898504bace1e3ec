"""Ids of texts by a ``tokenizer.json`` of words, remembering what each word gave.

A tokenizer that normalises by NFC, blanks and lower case, splits into words by a pattern
and merges inside words alone gives a text the ids of its words, one after the other. A
word is then encoded by the library once in a worker and remembered. That is done only
where the characters of a text are sure to be normalised and split one by one: a text with
any character beyond ``PLAIN``, or with a special string, goes to the library as a whole,
and so does every text of a tokenizer of any other make.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

#: Texts of these characters alone are normalised character by character: no combining marks, no control characters,
#: no blanks or digits beyond ASCII, and nothing whose lower case is longer than one character.
PLAIN = re.compile(r"[\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]*")
#: Words that are remembered at once in a worker.
REMEMBERED = 1_000_000
#: Words that the library gets at once.
TOGETHER = 100
#: Fixed value: the pattern of words that is known.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same for texts of ``PLAIN`` characters, in terms that Python's own module has.
_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


class Numbers(dict):
    """Gives each new key the next number and keeps it in ``new``."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class WordCodec:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        pattern = splits[0].get("pattern", {}).get("Regex") if splits and splits[0]["type"] == "Split" and splits[0]["invert"] and splits[0]["behavior"] == "Removed" else None
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and pattern == WORDS and spec["post_processor"] is None and [s["type"] for s in splits[1:]] == ["ByteLevel"]
        self.words = Tokenizer(self.library.model)  # takes words as they are
        self.words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or "(?!)")
        #: Ids take two bytes where they fit.
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self._forget()

    def _forget(self) -> None:
        self.numbers = Numbers()
        self.first, self.size, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        lists = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)]
        made = self.words.encode_batch(lists, is_pretokenized=True, add_special_tokens=False)
        size = np.concatenate([np.bincount(e.word_ids, minlength=len(words)) for e, words in zip(made, lists, strict=True)])
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, *(np.array(e.ids, self.kind) for e in made)])

    def encode(self, texts: Sequence[str]) -> list[np.ndarray]:
        """The ids of each text, without any that stand for a text's begin or end."""
        plain = [self.by_word and PLAIN.fullmatch(t) is not None and self.special.search(t) is None for t in texts]
        if len(self.numbers) > REMEMBERED:
            self._forget()
        number = self.numbers.__getitem__
        found = [np.fromiter(map(number, w), np.int64, len(w)) for w in (_WORDS.findall(t.lower()) for t, p in zip(texts, plain, strict=True) if p)]
        self._learn()
        whole = iter(self._library([t for t, p in zip(texts, plain, strict=True) if not p]))
        known = iter(found)
        out = []
        for p in plain:
            if not p:
                out.append(np.array(next(whole), self.kind))
                continue
            words = next(known)
            size = self.size[words]
            ends = np.cumsum(size)
            where = np.repeat(self.first[words] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            out.append(self.ids[where])
        return out


@lru_cache(maxsize=2)
def word_codec(path: str) -> WordCodec:
    return WordCodec(path)
