"""Spelling variants: words one edit apart, found by the hashes of their deletions.

Two words differ by one inserted or deleted code point if one is the other without some
code point, and by one replaced if both are equal without the code point at one place. So
every word sends one key for each place, the hash of the word without it, and one for the
whole word. With ``S[i] = sum of t[c[j]] * B**j for j < i`` modulo 2**64, the word without
place i hashes to ``S[i] + (S[L] - S[i+1]) / B``: prefix sums give the keys of a whole
batch at once, and a word of L code points costs L + 1 keys of 8 bytes, however long it is.

Keys are dealt by their value and sorted in their partition; a key that only one word has
is dropped there. What is left gets the words themselves back and is grouped by the real
string, so equal hashes of different strings decide nothing. A group holds at most one
whole word, and as many words for each place as the alphabet has letters, so no group grows
with the corpus. Groups are counted and their most frequent words found by windows, and no
pairs are made.

Words count over all documents, added up in the task before they are shuffled. Null texts
have no words, a null id counts as an empty string where words are altered, repeated rows
count each on its own, and an empty table gives no rows. Only the id and the text are read,
whatever else the columns are named.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import discard, lean, quoted, settled
from .text import mix

#: Words are runs of these, of so many code points at least.
LETTERS = "A-Za-zÀ-ÿ"
LEAST = 7
#: One run in so many loses a code point.
ALTERED = 31
#: Occurrences that a word has at least.
OFTEN = 2
#: A form is so many times as frequent as its variant.
RATIO = 10
#: Words that a task counts before it passes them on.
HELD = 200_000
#: Code points of the words whose keys are made at once.
CHUNK = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = np.uint64(pow(_BASE, -1, 1 << 64))
#: A number for each letter; all letters lie below 256.
_NUMBERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, altered: int = ALTERED) -> DataFrame:
    """(word, n) of all words with at least ``least`` code points.

    A run of letters is lower-cased (A-Z only); where ``altered`` divides the CRC-32 of its id and itself, it loses one code point.
    """
    # a run that is too short stays so
    runs = re.compile(f"[{LETTERS}]{{{least},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for word, n in Counter(runs((text or "").encode().lower().decode())).items():  # bytes lower A-Z alone
                    h = zlib.crc32(word.encode(), seed)
                    if h % altered == 0:
                        k = h % len(word)
                        word = word[:k] + word[k + 1 :]
                        if len(word) < least:
                            continue
                    held[word] += n
            if len(held) >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    read = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return read.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, place, first, key): a key for each word as it is, at place -1, and without each place.

    ``first`` is false where the same letter stands before: the word without it is the same as without that one.
    """
    size = np.array([len(w) for w in words], np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    letters = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    powers = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.zeros(at[-1] + 1, np.uint64)
    np.cumsum(_NUMBERS[letters] * powers[place], out=sums[1:])
    start, end = np.repeat(sums[at[:-1]], size), np.repeat(sums[at[1:]], size)
    without = (sums[:-1] - start) + (end - sums[1:]) * _INVERSE
    first = np.ones(len(letters), bool)
    first[1:] = (letters[1:] != letters[:-1]) | (place[1:] == 0)
    whole = sums[at[1:]] - sums[at[:-1]]
    n = np.arange(len(words))
    return np.concatenate([n, np.repeat(n, size)]), np.concatenate([np.full(len(n), -1), place]), np.concatenate([np.ones(len(n), bool), first]), mix(np.concatenate([whole, without]))


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        words, lo = b.column(1).to_pylist(), 0
        while lo < len(words):
            hi, size = lo, 0
            while hi < len(words) and (hi == lo or size + len(words[hi]) <= CHUNK):
                size += len(words[hi])
                hi += 1
            word, place, first, key = deletion_keys(words[lo:hi])
            ids = b.column(0).to_numpy()[lo:hi]
            for i in range(0, len(key), CHUNK):
                j = slice(i, i + CHUNK)
                yield pa.RecordBatch.from_arrays([pa.array(key[j].view(np.int64)), pa.array(place[j].astype(np.int32)), pa.array(ids[word[j]]), pa.array(first[j])], names=["key", "place", "id", "first"])
            lo = hi


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and place, those that another word may stand one edit from."""
    held: list[np.ndarray] | None = None

    def kept(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, place, ids, first = columns
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        sub = new.copy()
        sub[1:] |= place[1:] != place[:-1]
        run, part = np.cumsum(new) - 1, np.cumsum(sub) - 1
        starts = np.flatnonzero(new)
        has_whole = place[starts] == -1  # the whole word comes first
        replaced = (np.bincount(part)[part] > 1) & (place >= 0)
        inserted = has_whole[run] & (np.bincount(run)[run] > 1) & first
        k = replaced | inserted
        if k.any():
            yield pa.RecordBatch.from_arrays([pa.array(place[k]), pa.array(ids[k]), pa.array(replaced[k]), pa.array(inserted[k])], names=["place", "id", "replaced", "inserted"])

    for b in batches:
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        last = int(np.searchsorted(columns[0], columns[0][-1]))  # the last key may go on in the next batch
        yield from kept([c[:last] for c in columns])
        held = [c[last:] for c in columns]
    if held is not None:
        yield from kept(held)


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best): how many of the words (id, word, n) are one edit from each, and the most frequent of those as (-n, word)."""
    keys = words.select("id", "word").mapInArrow(lean(_keys), "key long, place int, id long, first boolean")
    found = keys.repartition("key").sortWithinPartitions("key", "place").mapInArrow(lean(_shared), "place int, id long, replaced boolean, inserted boolean")
    real = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.expr("substring(word, 1, place)"), F.expr("substring(word, place + 2)")))
    rows = found.join(words, "id").select("id", "place", "replaced", "inserted", real.alias("rest"), F.struct((-F.col("n")).alias("m"), "word").alias("self"))
    whole, shorter = F.col("inserted") & (F.col("place") < 0), F.col("inserted") & (F.col("place") >= 0)
    group = W.partitionBy("rest")
    alike = W.partitionBy("rest", "place", "replaced")
    ranked = alike.orderBy("self")
    everywhere = ranked.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*",
        F.max(F.when(whole, F.col("self"))).over(group).alias("whole"),
        F.sum(shorter.cast("long")).over(group).alias("n_longer"),
        F.min(F.when(shorter, F.col("self"))).over(group).alias("longer"),
        F.when(F.col("replaced"), F.count("*").over(alike)).alias("n_alike"),
        F.row_number().over(ranked).alias("rank"),
        F.first("self").over(everywhere).alias("one"),
        F.nth_value("self", 2).over(everywhere).alias("two"),
    )
    by_edit = rows.select(
        "id",
        F.explode(
            F.array(
                F.struct(F.coalesce(F.col("n_alike") - 1, F.lit(0)).alias("n"), F.when(F.col("n_alike") > 1, F.when(F.col("rank") == 1, F.col("two")).otherwise(F.col("one"))).alias("best")),
                F.struct(
                    F.when(whole, F.col("n_longer")).when(shorter & F.col("whole").isNotNull(), 1).otherwise(0).cast("long").alias("n"),
                    F.when(whole, F.col("longer")).when(shorter, F.col("whole")).alias("best"),
                ),
            )
        ).alias("edit"),
    ).where("edit.n > 0")
    return by_edit.groupBy("id").agg(F.sum("edit.n").alias("n_near"), F.min("edit.best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last of the forms that follow one another from each word. Each round doubles how far a word sees."""
    seen = settled(forms.select("word", F.col("form").alias("root")))
    while True:
        further = seen.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = settled(seen.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        discard(seen)
        seen = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return seen
        seen._settled_in = after._settled_in


def group_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, altered: int = ALTERED, often: int = OFTEN, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word with ``often`` occurrences or more.

    ``form`` is the most frequent word one edit away (ties: the first in order of code points) if it is at
    least ``ratio`` times as frequent, ``root`` the last of the forms that follow one another.
    """
    counted = count_words(docs, id_col, text_col, least, altered).where(F.col("n") >= often)
    words = settled(counted.withColumn("id", F.monotonically_increasing_id()))
    best = F.col("best")
    is_form = -best["m"] >= ratio * F.col("n")
    near = settled(
        words.join(near_words(words), "id", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, best["word"]).alias("form"), F.when(is_form, -best["m"]).alias("form_n")
        )
    )
    discard(words)
    roots = _roots(near.where("form IS NOT NULL"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
