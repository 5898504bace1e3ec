"""Token counts from distinct pre-tokens.

Documents are taken in blocks of about ``BLOCK_CHARS`` characters. A block keeps each
document's pre-token frequencies as numbers into the block's own list of distinct
pre-tokens, packed and compressed, and is written once to the shared folder. The lists
then meet across blocks, shuffled and sorted by pre-token: every distinct pre-token of the
corpus is encoded once, its number of pieces is joined to its rows as they stream by, and
each block sums frequencies times pieces. A frequent pre-token has one row per block, not
per occurrence; token ids are counted and dropped at once.

Null texts count as empty and have no tokens. Repeated rows are counted each on its own,
ids may be null, and an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .session import lean, quoted, settled

BLOCK_CHARS = 24 << 20
#: Characters whose pre-tokens are numbered together.
_CHUNK = 1 << 20


def _pack(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a).tobytes(), 3)


def _unpack(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


class _Block:
    def __init__(self, id_type: pa.DataType):
        self.ids: list[pa.Array] = []
        self.n_bytes: list[np.ndarray] = []
        self.number: dict[str, int] = {}
        self.sizes: list[np.ndarray] = []
        self.entries: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0
        self.id_type = id_type

    def add(self, ids: pa.Array, texts: list[str], find) -> None:
        """Adds documents: their distinct pre-tokens by number, in order of number, and how often each occurs."""
        found = [find(t) for t in texts]
        size = np.array([len(x) for x in found], np.int64)
        coded = pa.array([p for x in found for p in x], pa.string()).dictionary_encode()
        number = self.number
        own = np.array([number.setdefault(p, len(number)) for p in coded.dictionary.to_pylist()], np.uint64)
        key = np.repeat(np.arange(len(texts), dtype=np.uint64) << np.uint64(32), size)
        if len(key):
            key |= own[coded.indices.to_numpy(zero_copy_only=False)]
        distinct, counts = np.unique(key, return_counts=True)
        self.ids.append(ids)
        self.n_bytes.append(np.array([len(t.encode()) for t in texts], np.int64))
        self.sizes.append(np.bincount((distinct >> np.uint64(32)).astype(np.int64), minlength=len(texts)).astype(np.uint32))
        self.entries.append((distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        self.counts.append(counts.astype(np.uint32))
        self.chars += sum(map(len, texts))

    def row(self, block: int) -> pa.RecordBatch:
        sizes, entries = np.concatenate(self.sizes), np.concatenate(self.entries)
        steps = np.diff(entries, prepend=np.uint32(0))  # mostly small numbers, which compress; wraps at a new document
        names = [p.encode() for p in self.number]
        ids = pa.concat_arrays(self.ids)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                pa.array([np.concatenate(self.n_bytes).tobytes()], pa.binary()),
                pa.array([_pack(sizes)], pa.binary()),
                pa.array([_pack(steps.view(np.uint8).reshape(-1, 4).T)], pa.binary()),
                pa.array([_pack(np.concatenate(self.counts).view(np.uint8).reshape(-1, 4).T)], pa.binary()),
                pa.array([_pack(np.array([len(n) for n in names], np.uint32))], pa.binary()),
                pa.array([zstandard.compress(b"".join(names), 3)], pa.binary()),
            ],
            names=["block", "ids", "n_bytes", "sizes", "steps", "counts", "lengths", "pieces"],
        )


def _planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, "u1").reshape(4, -1).T).view("<u4").ravel()


def count_tokens(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        specials = sorted(codec(tokenizer, pattern).special, key=len, reverse=True)
        plain = regex.compile(pattern).findall
        apart = regex.compile("(" + "|".join(map(regex.escape, specials)) + ")") if specials else None

        def find(text: str) -> list[str]:
            if apart is None or not any(s in text for s in specials):
                return plain(text)
            return [p for i, part in enumerate(apart.split(text)) for p in ([part] if i % 2 else plain(part))]

        block, nth, first = None, 0, TaskContext.get().partitionId() << 32
        for b in batches:
            lo, texts = 0, b.column(1).fill_null("").to_pylist()
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= _CHUNK):
                    size += len(texts[hi])
                    hi += 1
                block = block or _Block(b.schema.field(0).type)
                block.add(b.column(0).slice(lo, hi - lo), texts[lo:hi], find)
                lo = hi
                if block.chars >= block_chars:
                    yield block.row(first + nth)
                    block, nth = None, nth + 1
        if block:
            yield block.row(first + nth)

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, lengths, pieces in zip(*(c.to_pylist() for c in b.columns), strict=True):
                at = np.concatenate([[0], np.cumsum(_unpack(lengths, "<u4"), dtype=np.int64)]).astype(np.int32)
                n = len(at) - 1
                names = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(at), pa.py_buffer(zstandard.decompress(pieces))])
                for lo in range(0, n, 50_000):
                    part = names.slice(lo, 50_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), block)), pa.array(np.arange(lo, lo + len(part), dtype=np.int32)), part], names=["block", "nth", "piece"])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pre-token; each distinct one is encoded once and its count joined to its rows."""
        c = codec(tokenizer, pattern)
        special = {s.encode() for s in c.special}
        before, n = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            runs = pc.run_end_encode(b.column(2))
            distinct, ends = runs.values.to_pylist(), runs.run_ends.to_numpy()
            counts = [1 if p in special else len(c.piece._encode_single_piece(p)) for p in distinct[1:]]
            n = n if distinct[0] == before else 1 if distinct[0] in special else len(c.piece._encode_single_piece(distinct[0]))
            counts = np.array([n, *counts], np.int32)
            before, n = distinct[-1], int(counts[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.repeat(counts, np.diff(ends, prepend=0)))], names=["block", "nth", "n"])

    def add_up(counted: pa.Table, blocks: pa.Table) -> pa.Table:
        nth, n = (counted[c].to_numpy() for c in ("nth", "n"))
        tokens = np.zeros(len(nth), np.int64)
        tokens[nth] = n
        out = []
        for b in blocks.to_pylist():
            sizes = _unpack(b["sizes"], "<u4").astype(np.int64)
            entries = np.cumsum(_planes(b["steps"]), dtype=np.uint32)
            made = np.concatenate([[0], np.cumsum(tokens[entries] * _planes(b["counts"]))])
            ends = np.cumsum(sizes)
            out.append(pa.table({id_col: pa.array(b["ids"], blocks.schema.field("ids").type.value_type), "n_bytes": np.frombuffer(b["n_bytes"], np.int64), "n_tokens": (made[ends] - made[ends - sizes]).astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({id_col: pa.array([], blocks.schema.field("ids").type.value_type), "n_bytes": pa.array([], pa.int64()), "n_tokens": pa.array([], pa.int64())})

    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(
        lean(number), f"block long, ids array<{id_type}>, n_bytes binary, sizes binary, steps binary, counts binary, lengths binary, pieces binary"
    )
    blocks = settled(rows)
    listed = blocks.select("block", "lengths", "pieces").mapInArrow(lean(lists), "block long, nth int, piece binary")
    counts = listed.repartition("piece").sortWithinPartitions("piece").mapInArrow(lean(pieces_of), "block long, nth int, n int")
    kept = blocks.drop("lengths", "pieces")
    return counts.groupBy("block").cogroup(kept.groupBy("block")).applyInArrow(add_up, f"{quoted(id_col)} {id_type}, n_bytes long, n_tokens long")
