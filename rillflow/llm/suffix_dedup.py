"""Removal of repeated passages by sorted suffixes.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts earlier in the
corpus. Two steps keep the sort small without losing a single such string:

1. Every string of ``LENGTH`` bytes names one suffix: the one at its smallest hash of
   ``LEAD`` bytes, the leftmost of equals. That choice depends on the string alone, so
   equal strings name suffixes with equal leading bytes, as far from their start. About one
   suffix in thirty is named. Leading bytes that occur once in the corpus are dropped.
2. The others are range-partitioned by their bytes, with splitters that Spark samples;
   the bytes before them, and then document order, spread a very frequent passage over tasks.
   Each task takes the suffixes of its range a few leads at a time, sorts them by multikey
   quicksort, eight bytes at a time, and sorts the bytes before them likewise. Common prefixes of neighbours in both orders then
   tell which strings are equal, whatever their place around the suffix, and the first
   in document order stays. A string can only go on in another range if its bytes from
   the suffix on are those of the first or last suffix of its own range; such strings
   are compared across boundaries by a shuffle on the string.

Texts are shuffled once, by document. Order is by id, null first, then by a hash of the
text, then by place. Null and empty texts have no bytes. Texts shorter than ``LENGTH``
never lose a byte. Rows equal in id and text are one document and get the same result.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from . import text as T
from .near_dedup import groups
from .session import lean, quoted

LENGTH = 100
LEAD = 32
#: Places that a suffix can have in a string that names it.
PLACES = LENGTH - LEAD + 1
#: Bytes before a suffix that place it among equal ones.
NEXT = 16
#: Leads, and sorted suffixes, that a task works on at a time.
HELD, CHUNK = 1 << 20, 1 << 15
#: Windows of a long text that are looked at together.
STEP = (1 << 20) - 256


def named_suffixes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash of the lead, text, place in the text, nearest start of a string, farthest start), distances back from the suffix."""
    n = len(data)
    room = np.maximum(np.diff(at) - LENGTH + 1, 0)
    if n < LENGTH or not room.any():
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none, none
    sums, down = T.rolling(data)
    lead = T.mix((sums[LEAD:] - sums[: n - LEAD + 1]) * down[: n - LEAD + 1])
    bits = np.uint64(21)  # blocks are shorter than that
    low = ((lead >> bits) << bits) | np.arange(len(lead), dtype=np.uint64)
    width = 1
    while 2 * width <= PLACES:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < PLACES:
        low = np.minimum(low[: len(low) - PLACES + width], low[PLACES - width :])
    first = np.concatenate([[0], np.cumsum(room)])
    starts = np.arange(first[-1]) + np.repeat(at[:-1] - first[:-1], room)
    chosen = (low[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    run = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(run[1:], len(chosen)) - 1
    place = chosen[run]
    text = np.searchsorted(at, starts[run], "right") - 1
    return lead[place], text, place - at[text], place - starts[last], place - starts[run]


def _pieces(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """(first row, bytes, offsets, place of the first byte): blocks of texts, or parts of a long one that share LENGTH - 1 bytes."""
    for lo, _, data, at in T.blocks(texts):
        if len(data) <= STEP + LENGTH:
            yield lo, data, at, 0
            continue
        for text in range(len(at) - 1):
            own = data[at[text] : at[text + 1]]
            for start in range(0, max(1, len(own) - LENGTH + 1), STEP):
                part = own[start : start + STEP + LENGTH - 1]
                yield lo + text, part, np.array([0, len(part)]), start


def _planes(a: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(a.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def _numbers(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _leads(n_buckets: int):
    """Leads by range of their hash: packed hashes, document keys, and suffixes as place, nearest and farthest start.

    Of a lead that is held more than once at a time, one goes to its bucket; all go, marked by a
    null hash, to buckets chosen by document, as it is already known that they repeat.
    """

    def packed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        lead, key, suffix = (np.concatenate(x) for x in zip(*parts, strict=True))
        _, first, which, times = np.unique(lead, return_index=True, return_inverse=True, return_counts=True)
        again = np.flatnonzero(times[which] > 1)
        shift = np.uint64(32)
        bucket = np.concatenate([((lead[first] >> shift) * np.uint64(n_buckets)) >> shift, (T.mix(key[again].view(np.uint64)) >> shift) % np.uint64(n_buckets)]).astype(np.int32)
        # a repeated lead's own entry says only that it is there
        entry = np.concatenate([np.where(times > 1, -1, suffix[first]), suffix[again]])
        plain = np.concatenate([np.ones(len(first), bool), np.zeros(len(again), bool)])
        lead = np.concatenate([lead[first], np.zeros(len(again), np.uint64)])
        key = np.concatenate([key[first], key[again]])
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        rows: list[tuple[int, bytes, bytes, bytes]] = []
        for k in np.flatnonzero(np.diff(cuts)):
            o = np.sort(order[cuts[k] : cuts[k + 1]])
            o = o[np.lexsort((entry[o], key[o], ~plain[o]))]
            # six bytes beside the bucket's range: leads that agree in them by chance only cost a comparison
            six = lead[o[plain[o]]].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rows.append((k, six.tobytes(), _planes(key[o]), _planes(entry[o])))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "leads", "keys", "suffixes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for b in batches:
            keys = b.column(0).to_numpy()
            for lo, data, at, start in _pieces(b.column(1)):
                lead, text, place, near, far = named_suffixes(data, at)
                parts.append((lead, keys[lo + text], ((place + start) << 16) | (near << 8) | far))
                held += len(lead)
                if held >= HELD:
                    yield packed(parts)
                    parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, suffix) of leads that occur more than once; a large bucket is looked at in parts of its leads' range."""
    names = ["key", "suffix"]
    for group in groups(batches, 1):
        packed = list(zip(*(group[c].to_pylist() for c in ("leads", "keys", "suffixes")), strict=True))
        n_parts = 1 + sum(len(six) for six, _, _ in packed) // (6 * HELD)
        for part in range(n_parts):
            leads, keys, suffixes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for six, k, s in packed:
                own = np.pad(np.frombuffer(six, np.uint8).reshape(-1, 6), ((0, 0), (0, 2))).view("<u8").ravel()
                k, s = _numbers(k), _numbers(s)
                if not part and len(own) < len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(k[len(own) :]), pa.array(s[len(own) :])], names=names)
                here = np.flatnonzero(own % np.uint64(n_parts) == part)
                leads.append(own[here])
                keys.append(k[here])
                suffixes.append(s[here])
            lead, key, suffix = np.concatenate(leads), np.concatenate(keys), np.concatenate(suffixes)
            order = np.argsort(lead)
            same = lead[order[1:]] == lead[order[:-1]]
            twice = np.zeros(len(lead), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            twice &= suffix >= 0
            yield pa.RecordBatch.from_arrays([pa.array(key[twice]), pa.array(suffix[twice])], names=names)


def _packer(n_kept: int):
    """Compresses each text before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3, write_content_size=True).compress
        for b in batches:
            data, at = T.flat(b.column(n_kept))
            raw = memoryview(data)
            packed = pa.array([pack(raw[at[i] : at[i + 1]]) for i in range(b.num_rows)], pa.binary())
            names = [b.schema.field(i).name for i in range(n_kept)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], packed], names=[*names, "packed"])

    return run


def _texts(packed: pa.Array) -> pa.Array:
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([unpack(x) for x in packed.to_pylist()], pa.large_binary())


def _merged(row: np.ndarray, packed: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and suffixes, with those that two parts of a long text name at one place made one, from the nearest to the farthest start.

    The starts whose strings name a suffix are one run, so no string comes in between.
    """
    place, near, far = packed >> 16, (packed >> 8) & 0xFF, packed & 0xFF
    fits = np.flatnonzero((place - far >= 0) & (place - near + LENGTH <= size[row]))
    order = fits[np.lexsort((place[fits], row[fits]))]
    row, place, near, far = row[order], place[order], near[order], far[order]
    new = np.ones(len(order), bool)
    new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    return row[first], (place[first] << 16) | (np.minimum.reduceat(near, first) << 8) | np.maximum.reduceat(far, first)


def _cutter():
    """One row per suffix: the bytes from it to the end of its last string, and those before it back to the start of its first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = T.flat(_texts(b.column(4)))
            offsets, packed = b.column(5).offsets.to_numpy(), b.column(5).values.to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(offsets))
            packed = packed[offsets[0] : offsets[-1]]
            if np.diff(at).max(initial=0) >= STEP + LENGTH:
                row, packed = _merged(row, packed, np.diff(at))
            for lo in range(0, len(packed), 20_000):
                s, r = packed[lo : lo + 20_000], row[lo : lo + 20_000]
                place, near, far = s >> 16, (s >> 8) & 0xFF, s & 0xFF
                fits = (place - far >= 0) & (place - near + LENGTH <= np.diff(at)[r])  # else it is of another text with this key
                r, place, near, far = r[fits], place[fits], near[fits], far[fits]
                here = at[r] + place
                yield pa.RecordBatch.from_arrays(
                    [b.column(1).take(pa.array(r)), b.column(2).take(pa.array(r)), pa.array(place), _gather(data, here, LENGTH - near), _gather(data, here - far, far)],
                    names=["id", "text_key", "place", "suffix", "before"],
                )

    return run


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[where])])


def _padded(strings: pa.Array, width: int, backwards: bool = False) -> np.ndarray:
    """The strings as rows of a matrix, filled up with zeros; one column at a time, which takes no room beside the matrix."""
    data, at = T.flat(strings)
    size = np.diff(at)
    out = np.zeros((len(size), -(-width // 8) * 8), np.uint8)
    for k in range(int(size.max(initial=0))):
        rows = np.flatnonzero(size > k)
        out[rows, k] = data[at[rows + 1] - 1 - k if backwards else at[rows] + k]
    return out


def multikey_order(strings: np.ndarray) -> np.ndarray:
    """Order of the rows of a byte matrix: sorted by eight bytes, and by the next eight only where they still agree."""
    words = strings.view(">u8").astype(np.uint64)
    order = np.argsort(words[:, 0], kind="stable")
    tied = np.zeros(len(order), np.int64)
    for d in range(1, words.shape[1]):
        column = words[order, d - 1]
        new = (column[1:] != column[:-1]) | (tied[1:] != tied[:-1])
        tied = np.concatenate([[0], np.cumsum(new)])
        size = np.bincount(tied)
        open_ = np.flatnonzero(size[tied] > 1)
        if not len(open_):
            break
        order[open_] = order[open_][np.lexsort((words[order[open_], d], tied[open_]))]
    return order


def _classes(strings: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each row, and the length that each row in order has in common with the one before it."""
    order = multikey_order(strings)
    differ = strings[order[1:]] != strings[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), strings.shape[1])
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank, np.concatenate([[-1], common])


def repeats(suffix: np.ndarray, before: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """For each row (rows in document order) and place: 0 no string, 1 the string's first occurrence, 2 a later one."""
    n = len(near)
    out = np.zeros((n, PLACES), np.uint8)
    rank, common = _classes(suffix)
    rank_before, common_before = _classes(before)
    for place in range(PLACES):
        rows = np.flatnonzero((near <= place) & (place <= far))
        if not len(rows):
            continue
        right = np.cumsum(common < LENGTH - place)[rank[rows]]
        left = np.cumsum(common_before < place)[rank_before[rows]]
        both = right * np.int64(n + 1) + left
        order = np.argsort(both, kind="stable")
        later = both[order[1:]] == both[order[:-1]]
        out[rows, place] = 1
        out[rows[order[1:][later]], place] = 2
    return out


def _spans(found: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end) of the bytes that repeated strings cover, one for each run of places."""
    wide = np.zeros((len(found), PLACES + 2), np.int8)
    wide[:, 1:-1] = found == 2
    step = np.diff(wide, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, place[row] - last + 1, place[row] - first + LENGTH


def _lead_bytes(suffix: pa.Array) -> np.ndarray:
    data, at = T.flat(suffix)
    return data[at[:-1, None] + np.arange(LEAD)]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, bool, bool]]:
    """(rows, whether they open the range, whether they close it): about ``CHUNK`` rows at a time of a range sorted by suffix.

    Cuts lie between different leads, so no string occurs in two chunks of a range.
    """
    held: list[pa.RecordBatch] = []
    n, enough, done = 0, CHUNK, None
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < enough:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        lead = _lead_bytes(rows["suffix"].combine_chunks())
        new = np.flatnonzero((lead[1:] != lead[:-1]).any(1))
        held, enough = rows.to_batches(), 2 * n
        if len(new):
            if done is not None:
                yield *done, False
            cut = int(new[-1]) + 1
            done = rows.slice(0, cut).combine_chunks(), done is None
            held = rows.slice(cut).combine_chunks().to_batches()
            n, enough = n - cut, max(CHUNK, 2 * (n - cut))
    if held:
        if done is not None:
            yield *done, False
        done = pa.Table.from_batches(held).combine_chunks(), done is None
    if done is not None:
        yield *done, True


def _reach(rows: pa.Table, opens: bool, closes: bool) -> np.ndarray:
    """How many leading bytes each suffix has in common with its range's first or last one.

    A suffix of another range has no more in common with it than the nearer of those two.
    """
    common = np.zeros(rows.num_rows, np.int64)
    if not (opens or closes):
        return common
    bytes_ = _padded(rows["suffix"].combine_chunks(), LENGTH)[:, :LENGTH]
    for edge in ([0] if opens else []) + ([rows.num_rows - 1] if closes else []):
        differ = bytes_ != bytes_[edge]
        common = np.maximum(common, np.where(differ.any(1), differ.argmax(1), LENGTH))
    return common


def _places(ids: pa.Array) -> np.ndarray:
    """Numbers in the order of ids of any type; those of nulls mean nothing."""
    if pa.types.is_integer(ids.type):
        return ids.fill_null(0).to_numpy(zero_copy_only=False)
    return pc.rank(ids, sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()


def _in_document_order(rows: pa.Table) -> pa.Table:
    """Each row once, as rows equal in id and text bring the same suffixes."""
    ids = rows["id"].combine_chunks()
    keys = [rows["place"].to_numpy(), rows["text_key"].to_numpy(), _places(ids), ids.is_valid().to_numpy(zero_copy_only=False)]
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    return rows.take(pa.array(order[new])).combine_chunks()


def _found(rows: pa.Table) -> np.ndarray:
    suffix, before = (rows[c].combine_chunks() for c in ("suffix", "before"))
    near, far = LENGTH - pc.binary_length(suffix).to_numpy(), pc.binary_length(before).to_numpy()
    return repeats(_padded(suffix, LENGTH), _padded(before, PLACES - 1, True), near, far)


def _within(n_buckets: int):
    """Of this task's range, in one pass: packed spans of strings that repeat one in it, and packed strings to compare with other ranges.

    The latter are strings whose bytes from the suffix on are also in this range's first or
    last suffix, each where it is first in the range, packed by bucket of the string. Both
    leave together, as a second reading of the range need not see the same cuts.
    """
    spread = np.multiply.accumulate(np.full(-(-LENGTH // 8), T._MUL, np.uint64))
    shift = np.uint64(32)
    names = ["bucket", "ids", "text_keys", "starts", "ends", "strings"]

    def spans(rows: pa.Table, found: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, keys, ids = rows["place"].to_numpy(), rows["text_key"].to_numpy(), rows["id"].combine_chunks()
        row, start, end = _spans(found, place)
        for lo in range(0, len(row), 5_000):
            r = row[lo : lo + 5_000]
            bucket = ((T.mix(keys[r[:1]].view(np.uint64) ^ np.uint64(start[lo])) >> shift) * np.uint64(n_buckets) >> shift).astype(np.int32)
            cuts = pa.array([0, len(r)], pa.int32())
            lists = (pa.ListArray.from_arrays(cuts, x) for x in (ids.take(pa.array(r)), pa.array(keys[r]), pa.array(start[lo : lo + 5_000]), pa.array(end[lo : lo + 5_000])))
            yield pa.RecordBatch.from_arrays([pa.array(bucket), *lists, pa.nulls(1, pa.binary())], names=names)

    def strings(rows: pa.Table, found: np.ndarray, reach: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, keys, ids = rows["place"].to_numpy(), rows["text_key"].to_numpy(), rows["id"].combine_chunks()
        suffix, before = _padded(rows["suffix"].combine_chunks(), LENGTH), _padded(rows["before"].combine_chunks(), PLACES - 1, True)
        around = np.concatenate([before[:, : PLACES - 1][:, ::-1], suffix[:, :LENGTH]], axis=1)
        row, back = np.nonzero((found == 1) & (np.arange(PLACES) >= LENGTH - reach[:, None]))
        for lo in range(0, len(row), 50_000):
            r, k = row[lo : lo + 50_000], back[lo : lo + 50_000]
            made = np.zeros((len(r), 8 * len(spread)), np.uint8)
            made[:, :LENGTH] = around[r[:, None], (PLACES - 1 - k)[:, None] + np.arange(LENGTH)]
            bucket = (((T.mix((made.view("<u8") * spread).sum(1)) >> shift) * np.uint64(n_buckets)) >> shift).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
            cuts = pa.array(np.append(first, len(order)).astype(np.int32))
            r, k = r[order], k[order]
            lists = (pa.ListArray.from_arrays(cuts, x) for x in (ids.take(pa.array(r)), pa.array(keys[r]), pa.array(place[r] - k)))
            packed = [zstandard.compress(x.tobytes(), 1) for x in np.split(made[order], first[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order][first]), *lists, pa.nulls(len(first), pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, opens, closes in _chunks(batches):
            rows = rows.append_column("reach", pa.array(_reach(rows, opens, closes)))
            rows = _in_document_order(rows)
            found, reach = _found(rows), rows["reach"].to_numpy()
            yield from spans(rows, found)
            chosen = np.flatnonzero(reach >= LEAD)
            yield from strings(rows.take(pa.array(chosen)), found[chosen], reach[chosen])

    return run


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one bucket: those that came as such, and of its strings all but the first of equal ones in document order."""
    names = ["id", "text_key", "start", "end"]
    for group in groups(batches, 1):
        done = group.filter(pc.is_null(group["strings"]))
        if done.num_rows:
            yield pa.RecordBatch.from_arrays([done[c].combine_chunks().flatten() for c in ("ids", "text_keys", "starts", "ends")], names=names)
        group = group.filter(pc.is_valid(group["strings"]))
        if not group.num_rows:
            continue
        ids, keys, starts = (group[c].combine_chunks().flatten() for c in ("ids", "text_keys", "starts"))
        strings = np.frombuffer(b"".join(map(zstandard.decompress, group["strings"].to_pylist())), np.uint8).reshape(len(ids), -1)
        in_order = np.lexsort([starts.to_numpy(), keys.to_numpy(), _places(ids), ids.is_valid().to_numpy(zero_copy_only=False)])
        order = in_order[multikey_order(strings[in_order])]
        again = pa.array(order[1:][(strings[order[1:]] == strings[order[:-1]]).all(1)])
        start = starts.take(again)
        yield pa.RecordBatch.from_arrays([ids.take(again), keys.take(again), start, pc.add(start, LENGTH)], names=names)


def _with_spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text_key, doc_key, packed, spans): each row of ``docs`` as a struct without its text, the
    text compressed, and its document's spans, as start << 32 | size."""
    spark = docs.sparkSession
    n_buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    id_type = docs.schema[id_col].dataType.simpleString()
    id_, text = F.col(quoted(id_col)), F.coalesce(F.col(quoted(text_col)), F.lit(""))
    key = F.xxhash64(id_, F.xxhash64(text))
    blobs = docs.where(F.octet_length(text) >= LENGTH).select(key, text).mapInArrow(lean(_leads(n_buckets)), "bucket int, leads binary, keys binary, suffixes binary")
    dealt = blobs.repartition("bucket").sortWithinPartitions("bucket")
    marked = dealt.mapInArrow(lean(_repeated), "key long, suffix long").groupBy("key").agg(F.collect_set("suffix").alias("suffixes"))
    # both joins below take all of these columns, so that Spark shuffles the texts once
    others = F.struct(F.col(quoted(text_col)).isNull().alias("no_text"), *(F.col(quoted(c)) for c in docs.columns if c != text_col))
    wide = docs.select(others.alias("row"), id_.alias("id"), F.xxhash64(text).alias("text_key"), key.alias("doc_key"), text.alias("text"))
    packed = StructType([*wide.schema.fields[:4], StructField("packed", BinaryType())])
    wide = wide.mapInArrow(lean(_packer(4)), packed).repartition("doc_key")
    met = wide.join(marked, wide["doc_key"] == marked["key"])
    cut = met.select("row", "id", "text_key", "doc_key", "packed", "suffixes").mapInArrow(lean(_cutter()), f"id {id_type}, text_key long, place long, suffix binary, before binary")
    ranged = cut.repartitionByRange("suffix", F.substring("before", -NEXT, NEXT), "id", "text_key", "place").sortWithinPartitions("suffix")
    found = ranged.mapInArrow(lean(_within(n_buckets)), f"bucket int, ids array<{id_type}>, text_keys array<long>, starts array<long>, ends array<long>, strings binary")
    spans = found.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lean(_met_again), f"id {id_type}, text_key long, start long, end long")
    span = F.struct("text_key", (F.shiftleft("start", 32) + F.col("end") - F.col("start")).alias("span"))
    spans = spans.groupBy(F.xxhash64("id", "text_key").alias("key")).agg(F.collect_list(span).alias("spans"))
    joined = wide.join(spans, wide["doc_key"] == spans["key"], "left")
    return joined.select("row", "id", "text_key", "doc_key", "packed", "spans")


def _union(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs; spans that touch are one run."""
    spans = np.sort(spans)
    start, end = spans >> 32, np.maximum.accumulate((spans >> 32) + (spans & 0xFFFFFFFF))
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    return start[first], end[np.append(first[1:], len(start)) - 1]


def _cut_rows(texts: pa.Array, own: np.ndarray, lists: pa.ListArray) -> Iterator[tuple[int, bytes, int, int]]:
    """(bytes, what remains, bytes removed, runs) of each text."""
    data, at = T.flat(texts)
    offsets, packed = lists.offsets.to_numpy(), lists.values
    keys, spans = packed.field(0).to_numpy(), packed.field(1).to_numpy()
    for i in range(len(own)):
        text = data[at[i] : at[i + 1]]
        a, z = offsets[i], offsets[i + 1]
        mine = spans[a:z][keys[a:z] == own[i]]
        if not len(mine):
            yield len(text), text.tobytes(), 0, 0
            continue
        start, end = _union(mine)
        edge = np.zeros(len(text) + 1, np.int8)
        edge[start] += 1
        edge[end] -= 1
        left = text[np.cumsum(edge[:-1]) == 0]
        yield len(text), left.tobytes(), len(text) - len(left), len(start)


def measure_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row; ``kept`` is binary, since a cut may part a character."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(_cut_rows(_texts(b.column(4)), b.column(2).to_numpy(), b.column(5)))
            size, kept, removed, runs = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = _with_spans(docs.select(quoted(id_col), quoted(text_col)), id_col, text_col)
    return rows.mapInArrow(lean(run), f"{quoted(id_col)} {id_type}, n_bytes long, n_removed long, n_spans long, kept binary")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the repeated bytes of its texts; characters that a cut parted go too, null texts stay null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            no_text, *fields = (b.column(0).field(i) for i in range(len(docs_names)))
            kept = [k.decode("utf-8", "ignore") for _, k, _, _ in _cut_rows(_texts(b.column(4)), b.column(2).to_numpy(), b.column(5))]
            fields.insert(place, pc.if_else(no_text, pa.scalar(None, pa.string()), pa.array(kept, pa.string())))
            yield pa.RecordBatch.from_arrays(fields, names=docs_names)

    docs_names = docs.columns
    return _with_spans(docs, id_col, text_col).mapInArrow(lean(run), docs.schema)
