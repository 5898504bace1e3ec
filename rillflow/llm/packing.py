"""Packing documents into training sequences of several context sizes.

Every document is encoded once and closed by an end id. Whole windows of the longest size
are cut off; the remainder is routed to the smallest tier that holds it. How many
remainders there are of each length, at most as many numbers as the longest tier has
places, is all that the plan is made from: tier by tier from the longest, a remainder opens
a window of its tier, and whole shorter remainders fill the gap, the longest that fits
first. Where none fits, one is cut to the size of the gap and its rest goes back. Equal
windows are planned as one group, so the plan says for a range of remainders of one length
which sequences they go to, and where. It has at most a few rows for each length whatever
the size of the corpus, and is the only thing that all tasks get.

A remainder finds its place by its length and its rank among those of that length: the
rank in its partition plus what the partitions before hold. Windows of a tier are numbered
by cost, the sum of the squares of their pieces' lengths, and dealt to the tier's steps
back and forth, so that the steps of a tier hold as many windows and cost nearly the same.

No window is padded but the last, and that one is cut into powers of two instead. Ids are
kept in two bytes where they fit, compressed, and shuffled at most once.

Null texts count as empty: the end id alone. Rows with equal or null ids are documents of
their own. An empty table gives no rows. Only the id and the text are read, whatever else
the columns are named.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import lean, quoted, settled
from .word_codec import word_codec

#: Context sizes, powers of two.
TIERS = (512, 1024, 2048, 4096)
#: Tokens of a training step.
STEP_TOKENS = 1 << 18
#: Characters of texts that are encoded at once.
CHUNK = 1 << 20
#: Bytes of ids in a batch of pieces.
_BATCH = 4 << 20


@dataclass(frozen=True)
class Part:
    """The piece (start, length) of the remainders of length ``of`` with ranks lo to hi - 1; ``per`` of them go to each window."""

    of: int
    lo: int
    hi: int
    start: int
    length: int
    per: int = 1

    def windows(self, lo: int, hi: int) -> Part:
        return replace(self, lo=self.lo + lo * self.per, hi=self.lo + hi * self.per)

    def cut(self, n: int) -> tuple[Part, Part]:
        return replace(self, length=n), replace(self, start=self.start + n, length=self.length - n)


class _Pool:
    """What is not placed yet, by length."""

    def __init__(self, counts: Mapping[int, int]):
        self.parts: dict[int, list[Part]] = {n: [Part(n, 0, c, 0, n)] for n, c in counts.items() if c}
        self.lengths = sorted(self.parts)

    def put(self, part: Part) -> None:
        part = replace(part, per=1)
        if part.length not in self.parts:
            self.parts[part.length] = []
            insort(self.lengths, part.length)
        self.parts[part.length].append(part)

    def take(self, length: int, windows: int, per: int) -> Part:
        """A part of that length for at most so many windows, with at most ``per`` ranks for each."""
        part = self.parts[length].pop()
        n = part.hi - part.lo
        per = max(1, min(per, n // windows if windows else n))
        k = min(windows or n // per, n // per) * per
        if k < n:
            self.parts[length].append(replace(part, lo=part.lo + k))
        part = replace(part, hi=part.lo + k, per=per)
        if not self.parts[length]:
            del self.parts[length]
            del self.lengths[bisect_left(self.lengths, length)]
        return part

    def fitting(self, gap: int) -> int | None:
        at = bisect_right(self.lengths, gap)
        return self.lengths[at - 1] if at else None


@dataclass(frozen=True)
class Group:
    """``n`` windows of one size, each with its ranks of all parts, one part after the other."""

    size: int
    n: int
    parts: tuple[Part, ...]

    @property
    def cost(self) -> int:
        return sum(p.per * p.length**2 for p in self.parts)


def pack_lengths(counts: Mapping[int, int], tiers: Sequence[int] = TIERS) -> list[Group]:
    """Groups of windows that hold every remainder exactly once, without padding; ``counts`` has how many there are of each length."""
    sizes = sorted(tiers)
    pool, done = _Pool(counts), []
    while pool.lengths:
        size = sizes[bisect_left(sizes, pool.lengths[-1])]
        first = pool.take(pool.lengths[-1], 0, size // pool.lengths[-1])
        open_ = [((first.hi - first.lo) // first.per, size - first.per * first.length, (first,))]
        while open_:
            n, gap, parts = open_.pop()
            while gap and pool.lengths:
                fit = pool.fitting(gap)
                part = pool.take(fit or pool.lengths[-1], n, gap // fit if fit else 1)
                if not fit:
                    part, rest = part.cut(gap)
                    pool.put(rest)
                if (k := (part.hi - part.lo) // part.per) < n:
                    open_.append((n - k, gap, tuple(p.windows(k, n) for p in parts)))
                    n, parts = k, tuple(p.windows(0, k) for p in parts)
                parts += (part,)
                gap -= part.per * part.length
            if not gap:
                done.append(Group(size, n, parts))
            elif n == 1 and not open_:
                done += _by_powers(parts)
            else:
                # nothing is left to fill the gaps with but what some windows hold: those of the largest group give way
                open_.append((n, gap, parts))
                n, gap, parts = open_.pop(max(range(len(open_)), key=lambda i: open_[i][0]))
                back = min(max(1, -(-n * gap // size)), n - (n > 1))
                for p in parts:
                    pool.put(p.windows(0, back))
                if n > back:
                    open_.append((n - back, gap, tuple(p.windows(back, n) for p in parts)))
    return done


def _by_powers(parts: Sequence[Part]) -> list[Group]:
    """The last window's parts as sequences whose lengths are powers of two."""
    left, out = [replace(p, lo=r, hi=r + 1, per=1) for p in parts for r in range(p.lo, p.hi)], []
    total = sum(p.length for p in left)
    for size in (1 << b for b in reversed(range(total.bit_length())) if total >> b & 1):
        held, need = [], size
        while need:
            part = left.pop(0)
            if part.length > need:
                part, rest = part.cut(need)
                left.insert(0, rest)
            held.append(part)
            need -= part.length
        out.append(Group(size, 1, tuple(held)))
    return out


@dataclass
class Plan:
    """Where pieces go: segments of (length, rank) with the pieces of each, and the windows of each tier."""

    keys: np.ndarray  # length << 40 | first rank of the segment
    ptr: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sequence: np.ndarray  # of the part's first window
    offset: np.ndarray
    lo: np.ndarray  # the part's first rank
    per: np.ndarray
    bounds: np.ndarray  # first sequence of each tier, and the end
    sizes: np.ndarray  # of each tier
    first_step: np.ndarray  # of each tier
    steps: np.ndarray  # in each tier
    full: int  # first sequence of the whole windows of long documents

    def step(self, sequence: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tier and step of sequences: dealt back and forth."""
        tier = np.searchsorted(self.bounds, sequence, "right") - 1
        turn, at = np.divmod(sequence - self.bounds[tier], self.steps[tier])
        return self.sizes[tier], self.first_step[tier] + np.where(turn % 2, self.steps[tier] - 1 - at, at)


def make_plan(counts: Mapping[int, int], n_full: int, tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS) -> Plan:
    groups = [*pack_lengths(counts, tiers), Group(max(tiers), n_full, (Part(0, 0, n_full, 0, max(tiers)),))]
    groups.sort(key=lambda g: (-g.size, -g.cost))
    rows, at, full, windows = [], 0, 0, {}
    for g in groups:
        windows[g.size] = windows.get(g.size, 0) + g.n
        if g.parts[0].of == 0:
            full, at = at, at + g.n
            continue
        offset = 0
        for p in g.parts:
            rows.append((p.of, p.lo, p.hi, p.start, p.length, at, offset, p.per))
            offset += p.per * p.length
        at += g.n
    windows = {s: n for s, n in windows.items() if n} or {max(tiers): 0}
    of, lo, hi, start, length, sequence, offset, per = np.array(rows, np.int64).reshape(-1, 8).T
    base = of << 40
    keys = np.unique(np.concatenate([base + lo, base + hi]))
    first, last = np.searchsorted(keys, base + lo), np.searchsorted(keys, base + hi)
    row = np.repeat(np.arange(len(of)), last - first)
    segment = np.arange(len(row)) - np.repeat(np.cumsum(last - first) - last, last - first)
    order = np.lexsort((start[row], segment))
    row, segment = row[order], segment[order]
    sizes, n = np.array(list(windows), np.int64), np.array(list(windows.values()), np.int64)
    steps = np.maximum(1, -(-n * sizes // step_tokens))
    return Plan(
        keys, np.searchsorted(segment, np.arange(len(keys) + 1)), start[row], length[row], sequence[row], offset[row], lo[row], per[row],
        np.concatenate([[0], np.cumsum(n)]), sizes, np.cumsum(steps) - steps, steps, full,
    )


def _tokenised(docs: DataFrame, tokenizer: str, end_id: int, window: int, id_col: str, text_col: str) -> DataFrame:
    """(part, id, n, rest, nth, full, ids): ``nth`` counts a part's documents of the same remainder, ``full`` the whole windows before."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, part = word_codec(tokenizer), TaskContext.get().partitionId()
        seen, full = np.zeros(window, np.int64), 0
        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            texts, lo = b.column(1).fill_null("").to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= CHUNK):
                    size += len(texts[hi])
                    hi += 1
                ids = [np.append(x, x.dtype.type(end_id)) for x in codec.encode(texts[lo:hi])]
                n = np.array([len(x) for x in ids], np.int64)
                rest, whole = n % window, n // window
                order = np.argsort(rest, kind="stable")
                dealt = rest[order]
                new = np.empty(len(n), np.int64)
                new[order] = np.arange(len(n)) - np.searchsorted(dealt, dealt) + seen[dealt]
                seen += np.bincount(rest, minlength=window)
                before = full + np.cumsum(whole) - whole
                full += int(whole.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(rest.astype(np.int32)), pa.array(new), pa.array(before), pa.array([pack(x.tobytes()) for x in ids], pa.binary())], names=["part", "id", "n", "rest", "nth", "full", "ids"])
                lo = hi

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text"))
    return rows.mapInArrow(lean(run), f"part int, id {id_type}, n long, rest int, nth long, full long, ids binary")


def pack(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", tiers: Sequence[int] = TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset, tier, step) of every piece; ``ids`` are little-endian unsigned 32-bit numbers.

    ``sequence_id`` counts the sequences from 0 without gaps, ``offset`` is the piece's place there,
    and ``tier`` is the sequence's size.
    """
    window = max(tiers)
    held = settled(_tokenised(docs, tokenizer, end_id, window, id_col, text_col))
    # whole windows count as remainders of length 0
    counted = held.groupBy("part", "rest").agg(F.count("*").alias("n")).where("rest > 0")
    counted = settled(counted.unionByName(held.groupBy("part").agg(F.sum(F.expr(f"n div {window}")).alias("n")).withColumn("rest", F.lit(0))))
    totals = {r.rest: r.n for r in counted.groupBy("rest").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    plan = make_plan({k: n for k, n in totals.items() if k}, totals.get(0, 0), tiers, step_tokens)
    before = W.partitionBy("rest").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counted.select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    bases = bases.join(bases.where("rest = 0").select("part", F.col("base").alias("full_base")), "part")
    placed = held.join(bases, ["part", "rest"]).select("id", "n", "rest", (F.col("nth") + F.col("base")).alias("rank"), (F.col("full") + F.col("full_base")).alias("first_full"), "ids")
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier", "step"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, unpack = word_codec(tokenizer).kind, zstandard.ZstdDecompressor().decompress
        for b in batches:
            n, rest, rank, first_full = (b.column(i).to_numpy().astype(np.int64) for i in range(1, 5))
            segment = np.searchsorted(plan.keys, rest << 40 | rank, "right") - 1
            whole, ids = n // window, b.column(5)
            cut = np.where(rest > 0, plan.ptr[segment + 1] - plan.ptr[segment] if len(plan.keys) else 0, 0)
            lo = 0
            ends = np.cumsum(4 * n)
            while lo < len(n):
                hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _BATCH)))
                few = slice(lo, hi)
                # the whole windows of each document, then the pieces of its remainder
                doc = np.concatenate([np.repeat(np.arange(lo, hi), whole[few]), np.repeat(np.arange(lo, hi), cut[few])])
                k = np.arange(whole[few].sum()) - np.repeat(np.cumsum(whole[few]) - whole[few], whole[few])
                j = np.arange(cut[few].sum()) - np.repeat(np.cumsum(cut[few]) - cut[few], cut[few])
                own = doc[len(k) :]
                at = plan.ptr[segment[own]] + j if len(own) else own
                turn, place = np.divmod(rank[own] - plan.lo[at], plan.per[at])
                start = np.concatenate([k * window, whole[own] * window + plan.start[at]])
                length = np.concatenate([np.full(len(k), window), plan.length[at]])
                sequence = np.concatenate([plan.full + first_full[doc[: len(k)]] + k, plan.sequence[at] + turn])
                offset = np.concatenate([np.zeros(len(k), np.int64), plan.offset[at] + place * plan.length[at]])
                order = np.lexsort((start, doc))
                doc, start, length, sequence, offset = doc[order], start[order], length[order], sequence[order], offset[order]
                tier, step = plan.step(sequence)
                # documents lie one after the other, and their pieces tile them
                flat = np.concatenate([np.frombuffer(unpack(ids[i].as_py()), kind) for i in range(lo, hi)]).astype("<u4")
                cuts = (np.concatenate([[0], np.cumsum(length)]) * 4).astype(np.int32)
                pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(cuts), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pieces, pa.array(n[doc]), pa.array(sequence), pa.array(offset), pa.array(tier.astype(np.int32)), pa.array(step)], names=names)
                lo = hi

    return placed.mapInArrow(lean(run), f"{quoted(id_col)} {id_type}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step long")


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, tier, step, ids, lengths): each sequence's ids, and the lengths of the pieces that attention stays inside of."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    whole = pieces.groupBy("sequence_id", "tier", "step").agg(parts.alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda held, p: F.concat(held, p["ids"]))
    return whole.select("sequence_id", "tier", "step", joined.alias("ids"), F.col("parts.length").alias("lengths"))
