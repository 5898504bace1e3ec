"""BPE encoding and decoding with tree concatenation of long texts.

A text of up to ``SEGMENT`` characters is encoded where it lies. A longer one is cut into
pieces of so many characters, anywhere. The pieces are encoded in parallel, each as if it
stood alone, and neighbours are joined as in a tree whose levels are Spark stages: a task
joins up to ``FAN`` neighbours pair by pair.

At a join, a window around the cut is split into pre-tokens anew. It starts at the last
place where the left side surely splits, whatever follows, and grows to the right until
one of its splits is also a split of the right side. From there on the right side's ids
stand, since a split depends only on what follows it; before the window the left side's
ids stand. Where the cut lies inside one long pre-token, ids inside it are joined by a
window that grows until its first token equals the left side's token at that place and
its last token the right side's. Then every pair of neighbouring tokens has been seen in
some true encoding, which makes the whole the true encoding.

Pieces of long texts and their ids are the only thing shuffled. Ids are those of the
``tokenizers`` library for the same vocabulary; its special strings become special tokens
wherever they stand. Null texts count as empty, an empty text has no tokens. Repeated rows
are encoded each on its own, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .session import discard, lean, quoted, settled

#: Characters of a text, or of a piece of one, that are encoded at once.
SEGMENT = 8_192
#: Neighbours that one task joins.
FAN = 8
#: Tokens on each side of a join in the first window.
WINDOW = 16
#: Fixed value: the usual pattern of byte-level vocabularies. It never matches across a space that follows something else.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters after a split that can have a say in it, beside a special string that begins among them: the longest
#: of the pattern's suffixes, and one to look ahead.
AHEAD = 4


def _byte_chars() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, reversed."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Codec:
    """Encoder and decoder for a byte-level ``tokenizer.json``."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_chars()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(chars[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        self.special = special
        self.whole = tiktoken.Encoding("whole", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.piece = tiktoken.Encoding("piece", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.usual = pattern == USUAL and not any(" " in s for s in special)
        self.sizes = {i: len(b) for b, i in ranks.items()} | {i: len(t.encode()) for t, i in special.items()}
        #: Ids between stages take two bytes where they fit.
        self.kind = "<u2" if max(self.sizes) < 1 << 16 else "<u4"
        self.margin = AHEAD + max(map(len, special), default=0)
        self._special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True))) or "(?!)")

    @property
    def splitter(self):
        from tokenizers import Tokenizer

        if not hasattr(self, "_splitter"):
            self._splitter = Tokenizer.from_file(self.path).pre_tokenizer
        return self._splitter

    def encode(self, text: str) -> list[int]:
        return self.whole.encode(text, allowed_special="all")

    def decode(self, ids: Sequence[int]) -> str:
        return self.whole.decode_bytes(ids).decode("utf-8", "replace")

    def pre_tokens(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """(start, end, whether special) of the parts that the merges never cross."""
        at = 0
        for found in [*self._special.finditer(text), None]:
            upto = found.start() if found else len(text)
            for _, (a, b) in self.splitter.pre_tokenize_str(text[at:upto]) if upto > at else ():
                yield at + a, at + b, False
            if found:
                yield found.start(), found.end(), True
                at = found.end()

    def sure_split(self, text: str) -> int | None:
        """The last place where the usual pattern splits whatever stands around it, if there is one; elsewhere none is known."""
        at = len(text) - self.margin if self.usual else 0
        while at > 0 and (at := text.rfind(" ", 1, at + 1)) > 0:
            if not text[at - 1].isspace():
                return at
            at -= 1
        return None

    def part(self, text: str, special: bool) -> list[int]:
        return [self.special[text]] if special else self.piece._encode_single_piece(text.encode())

    def spell(self, ids: Sequence[int]) -> bytes:
        return self.whole.decode_bytes(ids)


@lru_cache(maxsize=4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


@dataclass
class Node:
    """Encoding of a stretch of text as if it stood alone.

    ``tail`` counts the ids after its last sure split: its start, or a place where it splits whatever follows it.
    """

    ids: list[int]
    tail: int


def leaf(text: str, c: Codec) -> Node:
    at = c.sure_split(text)
    if at is not None:
        ids = c.encode(text)
        return Node(ids, _back(ids, len(text[at:].encode()), c))
    ids = []
    sure = 0
    for a, b, special in c.pre_tokens(text):
        if a + c.margin <= len(text):
            sure = len(ids)
        ids += c.part(text[a:b], special)
    return Node(ids, len(ids) - sure)


def concatenate(left: Node, right: Node, c: Codec, window: int = WINDOW) -> Node:
    """Encoding of two neighbouring stretches of text."""
    if not left.ids or not right.ids:
        return right if not left.ids else left
    tail = left.ids[len(left.ids) - left.tail :]
    before = c.spell(tail).decode()
    cut, n = len(before), window
    while True:
        n = min(n, len(right.ids))
        whole = n == len(right.ids)
        after = c.spell(right.ids[:n]).decode("utf-8", "ignore")  # at most the last character is in part
        text = before + after
        parts = list(c.pre_tokens(text))
        own = {cut + a for a, _, _ in c.pre_tokens(after)}
        # the first place at which both sides split; the end is one if nothing follows it
        meet = next((a for a, _, _ in parts if a in own and (whole or a + c.margin <= len(text))), len(text) if whole else None)
        if meet is not None:
            break
        n *= 2
    made: list[int] = []
    sure = 0
    last = [(a, b) for a, b, _ in c.pre_tokens(before)][-1:]
    first = next(((cut + a, cut + b) for a, b, _ in c.pre_tokens(after)), None)
    for a, b, special in parts:
        if a >= meet:
            break
        if a + c.margin <= len(text):
            sure = len(made)
        if not special and last == [(a, cut)] and first == (cut, b):
            # one pre-token of which each side holds a part
            one, two = _back(tail, len(text[a:cut].encode()), c), _ahead(right.ids, len(text[cut:b].encode()), c)
            made += join(tail[len(tail) - one :], right.ids[:two], c.piece._encode_single_piece, c.spell, window)
        else:
            made += c.part(text[a:b], special)
    kept = right.ids[_ahead(right.ids, len(text[cut:meet].encode()), c) :]
    ids = left.ids[: len(left.ids) - left.tail] + made + kept
    # the right side's last sure split is one of the whole if it comes after the two have met;
    # its start is one only if enough text follows
    far = right.tail < len(right.ids) or len(c.spell(right.ids[: 4 * c.margin]).decode("utf-8", "ignore")) >= c.margin
    return Node(ids, right.tail if far and right.tail <= len(kept) else len(made) - sure + len(kept))


def _ahead(ids: Sequence[int], size: int, c: Codec) -> int:
    """How many of the first ids spell ``size`` bytes."""
    n = 0
    while size > 0:
        size -= c.sizes[ids[n]]
        n += 1
    return n


def _back(ids: Sequence[int], size: int, c: Codec) -> int:
    return _ahead(ids[::-1], size, c)


def tree(nodes: list[Node], c: Codec, window: int = WINDOW) -> Node:
    """Joins neighbours pair by pair, level by level."""
    while len(nodes) > 1:
        nodes = [concatenate(nodes[i], nodes[i + 1], c, window) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
    return nodes[0]


def join(left: list[int], right: list[int], encode: Callable[[bytes], list[int]], spell: Callable[[Sequence[int]], bytes], window: int = WINDOW) -> list[int]:
    """Encoding of two neighbouring pieces of unsplit text, each given as its encoding."""
    if not left or not right:
        return left + right
    i = j = window
    while True:
        i, j = min(i, len(left)), min(j, len(right))
        made = encode(spell(left[-i:]) + spell(right[:j]))
        good_left = i == len(left) or made[0] == left[-i]
        good_right = j == len(right) or made[-1] == right[j - 1]
        if good_left and good_right:
            return left[:-i] + made + right[j:]
        i, j = (i if good_left else 2 * i), (j if good_right else 2 * j)


def encode(docs: DataFrame, tokenizer: str, pattern: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(*keep, ids) of every row, ``ids`` an array of ints."""
    return _encoded(docs, tokenizer, pattern, keep, text_col, segment, [("ids", "array<int>", pa.list_(pa.int32()))], lambda ids: (ids,))


def decode(encoded: DataFrame, tokenizer: str, pattern: str, keep: Sequence[str] = ("doc_id",), ids_col: str = "ids") -> DataFrame:
    """(*keep, text) of every row; null ids count as none."""
    names = list(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern)
        for b in batches:
            texts = [c.decode(ids or []) for ids in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    types = ", ".join(f"{quoted(c)} {encoded.schema[c].dataType.simpleString()}" for c in names)
    return encoded.select(*_aliased([*names, ids_col])).mapInArrow(lean(run), f"{types}, text string")


def round_trip(docs: DataFrame, tokenizer: str, pattern: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(*keep, n_tokens, ids_sha256, decoded_sha256): the digests of the ids and of the text decoded from them."""

    def digests(ids: list[int]) -> tuple[int, str, str]:
        text = codec(tokenizer, pattern).decode(ids)
        return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    columns = [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())]
    return _encoded(docs, tokenizer, pattern, keep, text_col, segment, columns, digests)


def pieces(docs: DataFrame, tokenizer: str, pattern: str, keep: Sequence[str] = ("doc_id",), text_col: str = "text", segment: int = SEGMENT) -> DataFrame:
    """(row, nth, n, *keep as a struct, ids, tail): the encoded pieces of each text of more than ``segment`` characters."""
    kept, text = F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in keep)).alias("kept"), F.coalesce(F.col(quoted(text_col)), F.lit(""))
    wide = docs.select(kept, text.alias("text")).where(F.length("text") > segment).select(F.monotonically_increasing_id().alias("row"), "kept", "text")

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                parts = [text[lo : lo + segment] for lo in range(0, len(text), segment)]
                for lo in range(0, len(parts), 256):
                    few = parts[lo : lo + 256]
                    same = pa.array([i] * len(few))
                    yield pa.RecordBatch.from_arrays([b.column(0).take(same), pa.array(range(lo, lo + len(few)), pa.int32()), pa.array([len(parts)] * len(few), pa.int32()), b.column(1).take(same), pa.array(few, pa.string())], names=["row", "nth", "n", "kept", "piece"])

    cut = wide.mapInArrow(lean(cut_up), f"{_struct(wide)}, piece string")

    def encode_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern)
        for b in batches:
            nodes = [leaf(t, c) for t in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array([_packed(x.ids, c) for x in nodes], pa.binary()), pa.array([x.tail for x in nodes], pa.int32())], names=_NODE)

    return cut.repartition("row", "nth").mapInArrow(lean(encode_pieces), f"{_struct(cut)}, ids binary, tail int")


def _aliased(names: Sequence[str]) -> list[Column]:
    """Columns under names that ``mapInArrow`` can look up, whatever theirs are."""
    return [F.col(quoted(c)).alias(f"_{i}") for i, c in enumerate(names)]


_NODE = ["row", "nth", "n", "kept", "ids", "tail"]


def _struct(df: DataFrame) -> str:
    inside = ", ".join(f"{quoted(f.name)}: {f.dataType.simpleString()}" for f in df.schema["kept"].dataType.fields)
    return f"row long, nth int, n int, kept struct<{inside}>"


def _packed(ids: list[int], c: Codec) -> bytes:
    return np.array(ids, c.kind).tobytes()


def unpacked(ids: bytes, c: Codec) -> list[int]:
    return np.frombuffer(ids, c.kind).tolist()


def join_level(nodes: DataFrame, tokenizer: str, pattern: str, fan: int = FAN) -> DataFrame:
    """Each ``fan`` neighbouring nodes of a text joined to one; ``n`` is how many the text has left."""

    def run(group: pa.Table) -> pa.Table:
        c = codec(tokenizer, pattern)
        group = group.sort_by("nth").combine_chunks()
        parts = zip(group["ids"].to_pylist(), group["tail"].to_pylist(), strict=True)
        made = tree([Node(unpacked(ids, c), tail) for ids, tail in parts], c)
        one = group.slice(0, 1)
        n = -(-group["n"][0].as_py() // fan)
        nth = group["nth"][0].as_py() // fan
        return pa.Table.from_arrays([one["row"], pa.array([nth], pa.int32()), pa.array([n], pa.int32()), one["kept"], pa.array([_packed(made.ids, c)], pa.binary()), pa.array([made.tail], pa.int32())], names=_NODE)

    dealt = nodes.withColumn("place", F.floor(F.col("nth") / fan))
    return dealt.groupBy("row", "place").applyInArrow(lambda key, group: run(group.drop(["place"])), f"{_struct(nodes)}, ids binary, tail int")


def _encoded(docs, tokenizer, pattern, keep, text_col, segment, columns, finish) -> DataFrame:
    """Short texts in one pass over the scan; long ones by their pieces."""
    keep = names = [c for c in keep if c not in {n for n, _, _ in columns}]  # a made column stands for one of its name
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    types = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in names)
    made = ", ".join(f"{n} {t}" for n, t, _ in columns)

    def rows(held: list[pa.Array], ids: list[list[int]]) -> pa.RecordBatch:
        arrays = list(zip(*(finish(x) for x in ids), strict=True)) or [[] for _ in columns]
        return pa.RecordBatch.from_arrays([*held, *(pa.array(a, t) for a, (_, _, t) in zip(arrays, columns, strict=True))], names=[*names, *(n for n, _, _ in columns)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern)
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                yield rows(part.columns[: len(names)], [c.encode(t) for t in part.column(len(names)).to_pylist()])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(tokenizer, pattern)
        for b in batches:
            for i in range(b.num_rows):
                kept = b.column(0).slice(i, 1).flatten()[1:]
                yield rows(kept, [unpacked(b.column(1)[i].as_py(), c)])

    near = docs.select(*_aliased(names), text.alias("_text")).where(F.length("_text") <= segment).mapInArrow(lean(short), f"{types}, {made}")
    nodes = settled(pieces(docs, tokenizer, pattern, keep, text_col, segment))
    done = []
    while nodes.where("n > 1").limit(1).count():
        before, nodes = nodes, settled(join_level(nodes.where("n > 1"), tokenizer, pattern))
        if not done:  # a long text has two pieces at least, so no piece is a whole text
            discard(before)
        done.append(nodes.where("n = 1").select("kept", "ids"))
    for part in done:
        near = near.unionByName(part.mapInArrow(lean(whole), f"{types}, {made}"))
    return near
