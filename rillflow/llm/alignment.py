"""Alignment of the tokens of two tokenizers over the same bytes.

A is a byte-level ``tokenizer.json`` and gets the text with a space before it, B a
sentencepiece model, which adds that space itself. Both are encoded by the stretches that
their merges never cross, each distinct stretch once in a worker. The cumulative ends of
the tokens of both sides are two sorted lists of bytes; merging them gives everything at
once. At each end of either side exactly one pair of tokens overlaps in the bytes just
before it, so there is one link for each distinct end, and where both sides end, a group
closes. The merge runs in ``mapInPandas`` over blocks of documents.

How often a pair of ids is linked in the whole corpus is counted by Spark: a block sends
each of its distinct pairs once with its number, the counts and the maxima of either side
are joined back to the blocks, and each block adds up its documents. The maxima are at most
as many as a vocabulary has ids and are broadcast. A frequent pair has one row for each
block, not for each link.

Texts that are null or empty, and those whose tokens do not spell the text on both sides,
have no tokens and only zeros. Repeated rows are documents of their own, ids may be null,
and an empty table gives no rows. Only the id and the text are read, whatever else the
columns are named.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import SEGMENT, codec, join
from .session import lean, quoted, settled
from .word_codec import Numbers

#: Characters of the documents of a block.
BLOCK_CHARS = 8 << 20
#: Characters that are encoded and merged at once.
CHUNK = 1 << 20
#: Stretches of a side that are remembered at once in a worker.
REMEMBERED = 600_000


class _Side:
    """Ids and byte lengths of stretches, each encoded once."""

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.numbers = Numbers()
        self.first, self.size, self.good = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        self.ids, self.bytes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        if not new:
            return
        made, good = self.encode(new)
        size = np.array(list(map(len, made)), np.int64)
        ids = np.array([i for x in made for i in x], np.int64)
        self.first = np.concatenate([self.first, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.good = np.concatenate([self.good, good])
        self.ids = np.concatenate([self.ids, ids])
        self.bytes = np.concatenate([self.bytes, self.sizes[ids]])

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(stretches of all texts, how many each text has, their tokens' places, how many tokens each text has)."""
        if len(self.numbers) > REMEMBERED:
            self.forget()
        found = [self.split(t) for t in texts]
        each = np.array([len(x) for x in found], np.int64)
        words = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(found)), np.int64, int(each.sum()))
        self.learn()
        size = self.size[words]
        ends = np.cumsum(size)
        where = np.repeat(self.first[words] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        upto = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(each)])]
        return words, each, where, np.diff(upto)


class _Bytes(_Side):
    """A: special strings are plain text."""

    def __init__(self, tokenizer: str, pattern: str):
        self.codec = codec(tokenizer, pattern)
        self.split = regex.compile(pattern).findall
        self.sizes = np.zeros(max(self.codec.sizes) + 1, np.int64)
        self.sizes[list(self.codec.sizes)] = list(self.codec.sizes.values())
        super().__init__()

    def _whole(self, piece: bytes) -> list[int]:
        """A long stretch is encoded in parts that are joined pair by pair, since the library's time grows with the square."""
        c, parts = self.codec, []
        one = c.piece._encode_single_piece
        for i in range(0, len(piece), SEGMENT):
            parts.append(one(piece[i : i + SEGMENT]))
        while len(parts) > 1:
            parts = [join(parts[i], parts[i + 1], one, c.spell) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0]

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], np.ndarray]:
        """The ids of each stretch, and whether they spell it."""
        one = self.codec.piece._encode_single_piece
        pieces = [s.encode() for s in stretches]
        return [one(p) if len(p) <= SEGMENT else self._whole(p) for p in pieces], np.ones(len(pieces), bool)


class _Pieces(_Side):
    """B: the merges never cross from another character to a space, nor between ASCII signs and other characters.

    That is so if no piece of the vocabulary holds two such neighbours. Characters that do stand beside a sign in
    some piece are ``odd``, and a text with one of them is split at spaces alone.
    """

    #: ASCII characters that are no letters and no space.
    SIGNS = r"\x00-\x1f!-@\[-`{-\x7f"
    #: Pieces for what does not begin with a space are made behind this; no piece of a vocabulary may hold it.
    GUARD = "\n"

    def __init__(self, model: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model)
        m, n = self.model, self.model.get_piece_size()
        self.spelled = [bytes([int(m.id_to_piece(i)[3:5], 16)]) if m.is_byte(i) else m.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.sizes = np.array([len(x) for x in self.spelled], np.int64)
        pieces = [m.id_to_piece(i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i))]
        odd = {c for p in pieces for pair in re.findall(f"(?=([{self.SIGNS}][^{self.SIGNS}▁]|[^{self.SIGNS}▁][{self.SIGNS}]))", p) for c in pair if not re.match(f"[{self.SIGNS}]", c)}
        self.odd = re.compile("[" + re.escape("".join(sorted(odd))) + "]" if odd else "(?!)")
        self.fine = re.compile(f" *(?:[{self.SIGNS}]+|[^ {self.SIGNS}]+)| +").findall
        self.coarse = re.compile(" *[^ ]+| +").findall
        self.space = m.piece_to_id("▁")
        self.guard = m.encode(self.GUARD)
        if any("▁" in p.lstrip("▁") for p in pieces) or any(self.GUARD in p for p in pieces) or len(self.guard) != 2:
            self.fine = self.coarse = lambda text: [text]
        super().__init__()

    def split(self, text: str) -> list[str]:
        return (self.coarse if self.odd.search(text) else self.fine)(text)

    def encode(self, stretches: list[str]) -> tuple[list[list[int]], np.ndarray]:
        # a space comes before whatever the library is given, so what has one gives it up, and what has none is put behind the guard
        opens = [s[0] == " " for s in stretches]
        made = self.model.encode([s[1:] if o else self.GUARD + s for s, o in zip(stretches, opens, strict=True)], num_threads=1)
        # nothing has no pieces, but a last space has one
        made = [(ids if s != " " else [self.space]) if o else ids[2:] for s, ids, o in zip(stretches, made, opens, strict=True)]
        spelled = self.spelled
        return made, np.array([b"".join([spelled[i] for i in ids]) == s.encode() for s, ids in zip(stretches, made, strict=True)], bool)


class Aligner:
    def __init__(self, tokenizer: str, pattern: str, model: str):
        self.a, self.b = _Bytes(tokenizer, pattern), _Pieces(model)
        n = max(max(self.a.codec.sizes) + 1, len(self.b.spelled))
        self.words = [f"{i}{end}" for i in range(n) for end in (",", "|", ";", "")]

    def merge(self, texts: list[str | None]) -> dict[str, np.ndarray | list[str]]:
        """Both sides' tokens, the groups and the links of a few texts.

        The first of the numbers by text are ``n_a``, ``n_b``, ``n_groups`` and ``n_links``; ``text`` names a link's text, ``link_a`` and ``link_b`` its
        ids, and ``groups`` has each text's groups, spelt ``a1,a2|b1;a3|b2,b3``.
        """
        rows = [i for i, t in enumerate(texts) if t]
        own = [" " + texts[i] for i in rows]
        words, each, where_b, n_b = self.b.of(own)
        # a text with a stretch that B spells otherwise has no tokens
        bad = np.zeros(len(own), np.int64)
        np.add.at(bad, np.repeat(np.arange(len(own)), each), ~self.b.good[words])
        fine = bad == 0
        where_b, n_b = where_b[np.repeat(fine, n_b)], n_b[fine]
        rows = np.array(rows, np.int64)[fine]
        _, _, where_a, n_a = self.a.of([t for t, ok in zip(own, fine, strict=True) if ok])
        ids_a, ids_b = self.a.ids[where_a], self.b.ids[where_b]
        ends_a, ends_b = np.cumsum(self.a.bytes[where_a]), np.cumsum(self.b.bytes[where_b])
        ends = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 1, np.uint8)
        ends[ends_a] = 1
        ends[ends_b] += 2
        at = np.flatnonzero(ends)
        in_a, in_b = ends[at] & 1, ends[at] >> 1
        both = in_a & in_b
        a, b = np.cumsum(in_a, dtype=np.int64) - in_a, np.cumsum(in_b, dtype=np.int64) - in_b
        of = np.repeat(np.arange(len(rows)), n_a)[a] if len(at) else np.zeros(0, np.int64)
        groups = np.bincount(of, both, len(rows)).astype(np.int64) if len(rows) else np.zeros(0, np.int64)
        out = {name: np.zeros(len(texts), np.int64) for name in ("n_a", "n_b", "n_groups", "n_links")}
        for name, n in (("n_a", n_a), ("n_b", n_b), ("n_groups", groups), ("n_links", np.bincount(of, minlength=len(rows)))):
            out[name][rows] = n
        spelled = [""] * len(texts)
        # a token's group is the number of groups closed before its end
        group = np.cumsum(both) - both
        group_a, group_b = group[np.flatnonzero(in_a)], group[np.flatnonzero(in_b)]
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        is_last_a, is_last_b = both[np.flatnonzero(in_a)], both[np.flatnonzero(in_b)]
        closing = np.zeros(len(ends_b), np.int64)
        if len(rows):
            closing[np.cumsum(n_b) - 1] = 1
        after = np.concatenate([np.where(is_last_a, 1, 0), np.where(is_last_b, np.where(closing, 3, 2), 0)])
        parts = (np.concatenate([ids_a, ids_b]) * 4 + after)[order].tolist()
        table, lo = self.words, 0
        for row, n in zip(rows.tolist(), (n_a + n_b).tolist(), strict=True):
            spelled[row] = "".join([table[p] for p in parts[lo : lo + n]])
            lo += n
        return out | {"groups": spelled, "text": rows[of] if len(rows) else of, "link_a": ids_a[a] if len(at) else a, "link_b": ids_b[b] if len(at) else b}


@lru_cache(maxsize=2)
def aligner(tokenizer: str, pattern: str, model: str) -> Aligner:
    return Aligner(tokenizer, pattern, model)


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHUNK):
            size += len(texts[hi] or "")
            hi += 1
        yield lo, hi
        lo = hi


def _packed(a: np.ndarray) -> bytes:
    """Numbers of four bytes, compressed by the planes of their bytes."""
    return zstandard.compress(np.ascontiguousarray(a.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpacked(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)


class _Block:
    def __init__(self):
        self.ids: list = []
        self.numbers: list[np.ndarray] = []
        self.digests: list[str] = []
        self.docs: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []
        self.chars = 0

    def add(self, ids: list, texts: list[str | None], found: Aligner) -> None:
        made = found.merge(texts)
        self.docs.append(made["text"] + len(self.ids))
        self.pairs.append(made["link_a"] << 32 | made["link_b"])
        self.numbers.append(np.stack([made[c] for c in _NUMBERS]))
        self.digests += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in made["groups"]]
        self.ids += ids
        self.chars += sum(len(t or "") for t in texts)

    def row(self, block: int) -> pd.DataFrame:
        """One row: the documents, the block's distinct pairs, and how often each document has which of them."""
        pairs, nth, n = np.unique(np.concatenate(self.pairs), return_inverse=True, return_counts=True)
        entry, times = np.unique(np.concatenate(self.docs) << 32 | nth, return_counts=True)
        sizes = np.bincount(entry >> 32, minlength=len(self.ids))
        steps = np.diff(entry & 0xFFFFFFFF, prepend=0).astype(np.uint32)  # small numbers, but at a new document
        columns = {"block": block, "numbers": np.concatenate(self.numbers, axis=1).tobytes(), "digests": "\n".join(self.digests)}
        columns |= {"sizes": _packed(sizes), "steps": _packed(steps), "times": _packed(times), "a": _packed(pairs >> 32), "b": _packed(np.diff(pairs & 0xFFFFFFFF, prepend=0).astype(np.uint32)), "n": _packed(n)}
        out = pd.DataFrame({k: [v] for k, v in columns.items()})
        out.insert(1, "ids", [self.ids])
        return out


#: What each document has, in this order in a block.
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


def blocks(docs: DataFrame, tokenizer: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Aligned documents in blocks of about ``block_chars`` characters."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, block, nth, first = aligner(tokenizer, pattern, model), None, 0, TaskContext.get().partitionId() << 32
        for f in frames:
            ids, texts = f["id"].astype(object).where(f["id"].notna(), None).tolist(), f["text"].where(f["text"].notna(), None).tolist()
            for lo, hi in _chunks(texts):
                block = block or _Block()
                block.add(ids[lo:hi], texts[lo:hi], found)
                if block.chars >= block_chars:
                    yield block.row(first + nth)
                    block, nth = None, nth + 1
        if block:
            yield block.row(first + nth)

    id_type = docs.schema[id_col].dataType.simpleString()
    # an id with nulls would become a float on its way to pandas
    rows = docs.select(F.col(quoted(id_col)).cast("string").alias("id"), F.col(quoted(text_col)).alias("text"))
    kinds = "block long, ids array<string>, numbers binary, digests string, sizes binary, steps binary, times binary, a binary, b binary, n binary"
    return rows.mapInPandas(run, kinds).withColumn("ids", F.col("ids").cast(f"array<{id_type}>"))


def _listed(made: DataFrame) -> DataFrame:
    """(block, nth, a, b, n): each block's distinct pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, a, b, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, n = _unpacked(a), _unpacked(n)
                b = np.cumsum(_unpacked(b).astype(np.uint32), dtype=np.uint32).astype(np.int64)
                for lo in range(0, len(a), 50_000):
                    k = slice(lo, lo + 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[k]), block)), pa.array(np.arange(lo, lo + len(a[k]), dtype=np.int32)), pa.array(a[k].astype(np.int32)), pa.array(b[k].astype(np.int32)), pa.array(n[k])], names=["block", "nth", "a", "b", "n"])

    return made.select("block", "a", "b", "n").mapInArrow(lean(run), "block long, nth int, a int, b int, n long")


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b) of all linked pairs of ids of ``blocks``: how many links they have, and whether none of a's or b's pairs has more."""
    counted = settled(_listed(made).groupBy("a", "b").agg(F.sum("n").alias("n")))
    tops = {side: F.broadcast(counted.groupBy(side).agg(F.max("n").alias(f"top_{side}"))) for side in ("a", "b")}  # a row for each id of a vocabulary at most
    return counted.join(tops["a"], "a").join(tops["b"], "b").select("a", "b", "n", (F.col("n") == F.col("top_a")).alias("best_a"), (F.col("n") == F.col("top_b")).alias("best_b"))


def align(docs: DataFrame, tokenizer: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``n_best`` counts the links whose pair is among the most frequent of its B id, ``count_sum`` adds up the pairs' counts over the links.
    """
    made = settled(blocks(docs, tokenizer, pattern, model, id_col, text_col, block_chars))
    scored = _listed(made).drop("n").join(pair_counts(made), ["a", "b"]).select("block", "nth", "n", "best_b")
    id_type = made.schema["ids"].dataType.elementType.simpleString()

    def add_up(pairs: pa.Table, rows: pa.Table) -> pa.Table:
        nth = pairs["nth"].to_numpy()
        count, best = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
        count[nth], best[nth] = pairs["n"].to_numpy(), pairs["best_b"].to_numpy().astype(np.int64)
        out = []
        for r in rows.to_pylist():
            times = _unpacked(r["times"])
            which = np.cumsum(_unpacked(r["steps"]).astype(np.uint32), dtype=np.uint32)
            ends = np.cumsum(_unpacked(r["sizes"]))
            starts = ends - _unpacked(r["sizes"])
            sums = {}
            for name, values in (("n_best", best), ("count_sum", count)):
                upto = np.concatenate([[0], np.cumsum(values[which] * times)])
                sums[name] = upto[ends] - upto[starts]
            numbers = np.frombuffer(r["numbers"], np.int64).reshape(4, -1)
            columns = {id_col: pa.array(r["ids"], rows.schema.field("ids").type.value_type)} | dict(zip(_NUMBERS, numbers, strict=True)) | sums
            out.append(pa.table(columns | {"groups_sha256": pa.array(r["digests"].split("\n"), pa.string())}))
        return pa.concat_tables(out) if out else pa.table({id_col: pa.array([], rows.schema.field("ids").type.value_type)} | {c: pa.array([], pa.int64()) for c in (*_NUMBERS, "n_best", "count_sum")} | {"groups_sha256": pa.array([], pa.string())})

    kept = made.drop("a", "b", "n")
    numbers = ", ".join(f"{c} long" for c in (*_NUMBERS, "n_best", "count_sum"))
    return scored.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(add_up, f"{quoted(id_col)} {id_type}, {numbers}, groups_sha256 string")


def groups(docs: DataFrame, tokenizer: str, pattern: str, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, groups): each text's groups, spelt ``a1,a2|b1;a3|b2,b3``; an empty string where there are no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = aligner(tokenizer, pattern, model)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(found.merge(texts[lo:hi])["groups"], pa.string())], names=[id_col, "groups"])

    read = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return read.mapInArrow(lean(run), f"{quoted(id_col)} {docs.schema[id_col].dataType.simpleString()}, groups string")
