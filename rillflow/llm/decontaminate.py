"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``width`` consecutive words (a shorter item is one
window), and a window into shingles. The documents that hold a window hold all of its
shingles, so one shingle is a long enough prefix to join on: the window's rarest, by how
often each shingle occurs in all documents. A window with a shingle that no document has
is out. Where a document holds a window's prefix, the window's place follows from the
shingle's place in it; places that don't leave room for the whole window are dropped, and
the rest are compared word by word.

Windows, shingles and their counts are tables. The documents are read three times, however
many items there are: to count the items' shingles, to look for prefixes, and to give
every document its result. What a scan looks for is first tried on a bit filter of at most
``FILTER_BITS`` bits, which is all that is broadcast without a check of its size; only what
passes it is counted or joined, with the words around it. Documents stay in one piece, and
are shuffled only if what is found in them is too large to be broadcast.

Null texts have no words and are never hit; items without words have no windows. Rows
with equal ids are judged each on its own. An item id that is null counts under the name
``null``. An empty table on either side gives no hits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .session import batch, discard, lean, quoted, settled

WIDTH = 10
#: Words of a shingle; a shorter window is one shingle.
SHINGLE = 3
FILTER_BITS = 1 << 28
#: Windows, and bytes of findings, that are broadcast at most; more are joined by a shuffle.
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 8 << 20


def _hash_words(words: Sequence[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return T.word_hashes(data, ends - [len(w) for w in words], ends)


def _item_words(text: str | None) -> list[bytes]:
    data = T.LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = T.spans(data, np.array([0, len(data)]), T.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends, strict=True)]


def _shingles(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of word runs of one width, which differ from those of other widths."""
    return T.mix(T.run_hashes(hashes, width) + np.uint64(width)).view(np.int64)


def item_windows(benchmark: DataFrame, item_col: str, item_text_col: str, width: int) -> DataFrame:
    """(words, items, shingles): distinct windows, words with a space between them, the items that hold each, its shingles in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = _item_words(text)
                found = {b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1) if words else 0)}
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(found), pa.string()), pa.array(list(found), pa.binary())], names=["item", "words"])

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for words in b.column(0).to_pylist():
                hashes = _hash_words(words.split(b" "))
                made.append(_shingles(hashes, min(SHINGLE, len(hashes))).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.list_(pa.int64()))], names=["words", "items", "shingles"])

    rows = benchmark.select(F.coalesce(F.col(quoted(item_col)).cast("string"), F.lit("null")), F.col(quoted(item_text_col)))
    windows = rows.mapInArrow(lean(cut), "item string, words binary").groupBy("words").agg(F.collect_set("item").alias("items"))
    return windows.mapInArrow(lean(shingled), "words binary, items array<string>, shingles array<long>")


class Filter:
    """Bits that tell which numbers are surely not among some; ``widths`` are the shingle widths that occur."""

    def __init__(self, shingles: DataFrame):
        n = shingles.count()
        self.n_bits = min(FILTER_BITS, max(1 << 12, 1 << (64 * n).bit_length()))
        self.bits = np.zeros(self.n_bits >> 6, np.uint64)
        mask = self.n_bits - 1
        places = F.explode(F.array(F.col("shingle").bitwiseAND(F.lit(mask)), F.shiftright("shingle", 32).bitwiseAND(F.lit(mask))))
        words = shingles.select(places.alias("p")).groupBy(F.shiftright("p", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("w"))
        for row in words.toLocalIterator():  # as many rows as the filter has numbers
            self.bits[row.at] = np.uint64(row.w & 0xFFFFFFFFFFFFFFFF)

    def passed(self, shingles: np.ndarray) -> np.ndarray:
        """Places of the shingles that may be among those of the filter."""
        at = np.arange(len(shingles))
        for shift in (0, 32):
            p = (shingles[at] >> np.int64(shift)) & np.int64(self.n_bits - 1)
            at = at[(self.bits[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1]
        return at


class _Docs:
    """Words and their hashes in a block of texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        data = T.LOWER[data]
        self.raw, self.at = data.tobytes(), at
        self.starts, self.ends, self.first = T.spans(data, at, T.ALNUM)
        self.hashes = T.word_hashes(data, self.starts, self.ends)
        self.text = np.repeat(np.arange(len(at) - 1), np.diff(self.first))

    def found(self, widths: Sequence[int], look: Filter) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(first words, shingles) of the runs within one text that pass the filter, by width."""
        for width in widths:
            made = _shingles(self.hashes, width)
            at = look.passed(made)
            at = at[self.text[at] == self.text[at + width - 1]]
            yield at, made[at]


def _keys(id_: Column, text: Column) -> list[Column]:
    """128 bits of a row's id and text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(id_, text).alias("k1"), F.xxhash64(text, id_, F.lit(1)).alias("k2")]


def _counted(docs: DataFrame, text_col: str, widths: Sequence[int], shared) -> DataFrame:
    """(shingle, n): how often each shingle that passes the filter occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [made for _, _, data, at in T.blocks(b.column(0)) for _, made in _Docs(data, at).found(widths, shared.value)]
            shingles, n = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingles), pa.array(n)], names=["shingle", "n"])

    return docs.select(F.col(quoted(text_col))).mapInArrow(lean(run), "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _met(docs: DataFrame, id_col: str, text_col: str, widths: Sequence[int], width: int, shared) -> DataFrame:
    """(k1, k2, shingle, place, around, back): where documents hold what passes the filter, with the words around it."""
    names = ["k1", "k2", "shingle", "place", "around", "back"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, _, data, at in T.blocks(b.column(2)):
                d = _Docs(data, at)
                for places, shingles in d.found(widths, shared.value):
                    text = d.text[places]
                    first = np.maximum(d.first[text], places - width + 1)
                    last = np.minimum(d.first[text + 1], places + width)
                    around = [b" ".join(d.raw[d.starts[k] : d.ends[k]] for k in range(i, j)) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                    own = pa.array(lo + text)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(own), b.column(1).take(own), pa.array(shingles), pa.array(places - d.first[text]), pa.array(around, pa.binary()), pa.array(places - first)], names=names)

    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    return docs.select(*_keys(id_, text), text).mapInArrow(lean(run), "k1 long, k2 long, shingle long, place long, around binary, back long")


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, start, end, items) of the windows that stand where their prefix says."""
    for b in batches:
        rows, ends = [], []
        for i, (around, back, words, off) in enumerate(zip(*(b.column(k).to_pylist() for k in (3, 4, 5, 6)), strict=True)):
            start, words = back - off, words.split(b" ")
            if start >= 0 and around.split(b" ")[start : start + len(words)] == words:
                rows.append(i)
                ends.append(len(words) - off)
        place, rows = b.column(2).to_numpy()[rows], pa.array(rows, pa.int64())
        start = place - b.column(6).to_numpy()[rows.to_numpy()]
        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(start), pa.array(place + np.array(ends, np.int64)), b.column(7).take(rows)], names=["k1", "k2", "start", "end", "items"])


def _findings(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, width: int) -> DataFrame:
    """(k1, k2, spans, items): what each document that holds a window holds."""
    context = docs.sparkSession.sparkContext
    windows = settled(item_windows(benchmark, item_col, item_text_col, width))
    each = windows.select("words", "items", F.size("shingles").alias("n_shingles"), F.posexplode("shingles").alias("off", "shingle"))
    n_words = F.when(F.size("shingles") > 1, SHINGLE).otherwise(F.least(F.lit(SHINGLE), F.size(F.split(F.col("words").cast("string"), " "))))
    widths = sorted(r[0] for r in windows.select(n_words).distinct().collect())  # 1 to SHINGLE at most
    counts = settled(_counted(docs, text_col, widths, context.broadcast(Filter(each.select("shingle").distinct()))))
    rarest = F.min(F.struct("n", "off", "shingle")).alias("rarest")
    prefixes = each.join(counts, "shingle").groupBy("words").agg(rarest, F.first("items").alias("items"), F.first("n_shingles").alias("n_shingles"), F.count("*").alias("n_met"))
    prefixes = settled(prefixes.where("n_met = n_shingles").select(F.col("rarest.shingle").alias("shingle"), F.col("rarest.off").cast("long").alias("off"), "words", "items"))
    met = _met(docs, id_col, text_col, widths, width, context.broadcast(Filter(prefixes.select("shingle").distinct())))
    few = prefixes.count() <= BROADCAST_WINDOWS
    joined = met.join(F.broadcast(prefixes) if few else prefixes, "shingle").select("k1", "k2", "place", "around", "back", "words", "off", "items")
    found = joined.mapInArrow(lean(_confirmed), "k1 long, k2 long, start long, end long, items array<string>")
    made = settled(found.groupBy("k1", "k2").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")))
    for done in (windows, counts, prefixes):
        discard(done)
    return made


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WIDTH, keep: Sequence[str] = ()
) -> DataFrame:
    """(id, *keep, n_words, n_hit, hit_spans, items) of every document.

    ``hit_spans`` lists first word and last word + 1 of each maximal run of hit words,
    ``items`` the ids of the items with a window in the document, sorted as strings. A kept
    column of one of these names gives way to it.
    """
    made = _findings(docs, benchmark, id_col, text_col, item_col, item_text_col, width)
    size = made.agg(F.sum(8 * F.size("spans") + F.octet_length(F.to_json("items")))).first()[0] or 0
    names = list(dict.fromkeys(c for c in [id_col, *keep] if c not in ("n_words", "n_hit", "hit_spans", "items")))
    kept = F.struct(F.lit(0).alias("_"), *(F.col(quoted(c)) for c in names)).alias("kept")
    id_, text = F.col(quoted(id_col)), F.col(quoted(text_col))
    if text_col in names:
        wide = docs.select(kept, text.alias("text"), *_keys(id_, text))
    else:  # the words are counted first, so that no text is ever shuffled
        wide = docs.select(kept, text.alias("text"), *_keys(id_, text)).mapInArrow(lean(_count_words), f"kept {docs.select(kept).schema['kept'].dataType.simpleString()}, n_words long, k1 long, k2 long")
    joined = wide.join(F.broadcast(made) if size <= BROADCAST_BYTES else made, ["k1", "k2"], "left")
    types = ", ".join(f"{quoted(c)} {docs.schema[c].dataType.simpleString()}" for c in names)
    return joined.select("kept", wide.columns[1], "spans", "items").mapInArrow(lean(_closer(names)), f"{types}, n_words long, n_hit long, hit_spans array<int>, items array<string>")


def _n_words(texts: pa.Array) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64)] + [np.diff(T.spans(T.LOWER[data], at, T.ALNUM)[2]) for _, _, data, at in T.blocks(texts)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_n_words(b.column(1))), b.column(2), b.column(3)], names=["kept", "n_words", "k1", "k2"])


def _closer(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counted = b.column(1) if pa.types.is_integer(b.column(1).type) else pa.array(_n_words(b.column(1)))
            spans = []
            for found in b.column(2).to_pylist():
                runs: list[int] = []
                for x in found or ():
                    if runs and x["start"] <= runs[-1]:
                        runs[-1] = max(runs[-1], x["end"])
                    else:
                        runs += [x["start"], x["end"]]
                spans.append(runs)
            n_hit = [sum(r[1::2]) - sum(r[::2]) for r in spans]
            items = [x or [] for x in b.column(3).to_pylist()]
            own = b.column(0).flatten()[1:]
            schema = pa.schema([*(pa.field(c, x.type) for c, x in zip(names, own, strict=True)), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("hit_spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
            yield batch(schema, *own, counted, n_hit, spans, items)

    return run


def leak_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, words hit, items, a digest of the sorted item ids, and whether any word is hit."""
    return find_leaks(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )
