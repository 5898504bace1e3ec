"""Near-duplicate detection on bottom-k sketches.

One hash function gives each five-word shingle a number; a document's sketch is the
``SKETCH`` smallest numbers of its set. Documents with the same words in the same order
form one class. Inverted lists of the retained values bring classes together, the sketch
of the union of two classes estimates their similarity and drops what lies far below the
threshold, and exact Jaccard similarities on full sets confirm every link.

No list is cut short and no pair of a large list is written out:

* A retained value that only one class holds leads nowhere. The others of a class are put
  in order of rarity; as two linked classes share at least ``_least_shared()`` retained
  values, the first few of each class, up to a prefix, are enough to meet.
* Values of at most ``COLD`` classes give all their pairs. The lists of more frequent
  values are dealt out in pairs of blocks of ``BLOCK`` classes. Inside a pair of blocks,
  sketches are compared by matrix products and only a spanning forest of what is similar
  leaves the task, without what the blocks' own links join already.
* In the lists of the first ``EARLY`` frequent values of each class, all classes are at first
  held against one block alone, as that brings most copies together. Then, of all frequent
  values, those lists follow in whole that still can join something: not lists whose
  classes are all in one candidate component by then, nor lists whose classes all have one
  and the same frequent value just before, whose list holds them all. In a list that
  follows, the classes of its largest component are held against the others only.
* Connected candidates are then compared in full, again in blocks and by matrix products
  of membership, and again only spanning forests leave a task. Each link of such a forest
  is held against the words of its two texts before it counts.

Prefix and estimate allow five standard deviations of a sketch, so a pair at the very
threshold is missed with a chance of about one in a million; sets of up to three quarters of
``SKETCH`` shingles are found without any such chance. A cluster of n different near
copies costs n * n / BLOCK set comparisons, spread over tasks.

Null and empty texts, and those without words, have an empty set and link with nothing. A
null id counts as a document but is never a component's id, unless all ids of the
component are null. Rows with equal ids are documents of their own. An empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import text as T
from .components import connected
from .session import batch, discard, lean, quoted, settled

WIDTH = 5
#: A link needs LEAST / 100 as Jaccard similarity.
LEAST = 75
SKETCH = 64
COLD = 16
EARLY = 6
#: Classes, and values of their sets, in a block.
BLOCK, BLOCK_VALUES = 512, 1 << 19
#: Up to so many ids of classes to compare are broadcast to the second scan; more are joined by a shuffle.
BROADCAST_IDS = 300_000


def _least_shared(k: int = SKETCH, share: float = LEAST / 100) -> int:
    """Retained values that two linked large sets share, less five standard deviations."""
    return math.floor(k * share - 5 * math.sqrt(k * share * (1 - share)))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes, non-negative in 63 bits, of each text."""
    data = T.LOWER[data]
    starts, ends, first = T.spans(data, at, T.SPACES)
    words = T.word_hashes(data, starts, ends)
    runs = T.run_hashes(words, width) >> np.uint64(1)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(runs[a : b - width + 1]))
        else:
            out.append(T.run_hashes(words[a:b], b - a) >> np.uint64(1) if b > a else runs[:0])
    return out


def _digests(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each text's lower-cased words, as two numbers."""
    data = T.LOWER[data]
    words, cuts = T.joined_words(data, *T.spans(data, at, T.SPACES))
    raw = memoryview(words)
    made = b"".join(hashlib.blake2b(raw[a:z], digest_size=16).digest() for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
    return np.frombuffer(made, "<i8").reshape(-1, 2)


def _wide(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(quoted(text_col))
    return docs.select(F.col(quoted(id_col)).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key"), text.alias("text"))


def sketches(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, d1, d2, sketch): size of each document's set, digest of its words, smallest values of the set."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = pa.schema([("id", b.schema.field(0).type), ("text_key", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("sketch", pa.list_(pa.int64()))])
            for lo, hi, data, at in T.blocks(b.column(2)):
                sets, digests = shingle_sets(data, at), _digests(data, at)
                kept = [s[:SKETCH].astype(np.int64) for s in sets]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in kept])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
                yield batch(schema, b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), [len(s) for s in sets], digests[:, 0], digests[:, 1], lists)

    return _wide(docs, id_col, text_col).mapInArrow(lean(run), f"id {id_type}, text_key long, n long, d1 long, d2 long, sketch array<long>")


def _slots(classes: DataFrame) -> DataFrame:
    """(value, node, n, hot, nth, before): the lists in which each class is looked for.

    Of a class's frequent values, ``nth`` counts from 0 and ``before`` is the one before.
    """
    values = classes.select("node", "n", F.size("sketch").alias("k"), F.explode("sketch").alias("value"))
    held = values.groupBy("value").agg(F.count("*").alias("held")).where("held > 1")
    shared = values.join(held, "value")
    ranked = F.struct((F.col("held") > COLD).alias("hot"), F.when(F.col("held") > COLD, 0).otherwise(F.col("held")).alias("rank"), "value")
    per_class = shared.groupBy("node").agg(F.first("n").alias("n"), F.first("k").alias("k"), F.sort_array(F.collect_list(ranked)).alias("v"))
    exact = math.floor(SKETCH * LEAST / 100)
    prefix = F.when(F.col("n") <= exact, F.col("n") - F.ceil(F.col("n") * LEAST / 100) + 1).otherwise(F.col("k") - _least_shared() + 1)
    # what no other class holds comes first in order of rarity and uses up the prefix
    room = F.greatest(F.lit(0), prefix - (F.col("k") - F.size("v"))).cast("int")
    cold = F.size(F.filter("v", lambda x: ~x["hot"]))
    chosen = per_class.select("node", "n", cold.alias("cold"), "v", F.posexplode(F.slice("v", F.lit(1), room)).alias("i", "x"))
    before = F.when(F.col("i") > F.col("cold"), F.get("v", F.col("i") - 1)["value"])
    return chosen.select("x.value", "node", "n", "x.hot", (F.col("i") - F.col("cold")).alias("nth"), before.alias("before"))


def _open_lists(frequent: DataFrame, roots: DataFrame) -> DataFrame:
    """(value, node, most) of the frequent values whose lists can still join something; ``most`` marks a list's largest component."""
    placed = frequent.join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = placed.groupBy("value", "root").agg(F.count("*").alias("n"), F.count("before").alias("n_before"), F.min("before").alias("low"), F.max("before").alias("high"))
    lists = parts.groupBy("value").agg(F.count("*").alias("roots"), F.max_by("root", "n").alias("largest"), F.sum("n").alias("n"), F.sum("n_before").alias("n_before"), F.min("low").alias("low"), F.max("high").alias("high"))
    inside = (F.col("n_before") == F.col("n")) & (F.col("low") == F.col("high"))
    wanted = lists.where((F.col("roots") > 1) & ~inside).select("value", "largest")
    return placed.join(wanted, "value").select("value", "node", (F.col("root") == F.col("largest")).alias("most"))


def _similar_pairs(slots: DataFrame, short: DataFrame) -> DataFrame:
    """(a, b) of classes that share an infrequent value and whose union sketch allows a link."""
    lists = slots.where(~F.col("hot")).groupBy("value").agg(F.sort_array(F.collect_list(F.struct("n", "node"))).alias("m")).where(F.size("m") > 1)
    one = lists.select(F.posexplode("m").alias("i", "x"), "m")
    two = one.select("x", F.explode(F.slice("m", F.col("i") + 2, F.size("m"))).alias("y"))
    near = two.where(F.col("x.n") * 100 >= F.col("y.n") * LEAST)
    pairs = near.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()
    with_a = pairs.join(short.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a")
    with_b = with_a.join(short.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return with_b.where(both * SKETCH >= F.size(union) * _least_shared()).select("a", "b")


def _blocked(rows: DataFrame, key: str, blocks: list, own: Column, others: Column) -> DataFrame:
    """Each row once for every pair of blocks that it takes part in: columns lo and hi name the pair, own the row's block.

    ``blocks`` gives aggregates of large groups, the first of them the number of blocks,
    from which ``own`` and ``others`` tell the row's block and those that it meets.
    """
    # few groups are that large, and only they take part in the join
    large = rows.groupBy(key).agg(*blocks).where("blocks > 1")
    placed = rows.join(large, key, "left").withColumn("own", F.when(F.col("blocks").isNull(), 0).otherwise(own).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(others)))
    return pairs.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).withColumn("blocks", F.coalesce("blocks", F.lit(1)))


def _upto(n: Column) -> Column:
    return F.sequence(F.lit(0), (n - 1).cast("int"))


def _every_pair(rows: DataFrame, key: str) -> DataFrame:
    n_blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("weight") / BLOCK_VALUES)).cast("int").alias("blocks")
    return _blocked(rows, key, [n_blocks], F.pmod(F.xxhash64("node"), F.col("blocks")), _upto(F.col("blocks")))


def _with_the_first(rows: DataFrame, key: str) -> DataFrame:
    """All blocks with the first one only."""
    own = F.pmod(F.xxhash64("node"), F.col("blocks"))
    return _blocked(rows, key, [F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")], own, F.when(own == 0, _upto(F.col("blocks"))).otherwise(F.array(F.lit(0))))


def _with_the_others(rows: DataFrame, key: str) -> DataFrame:
    """Blocks of the rows marked ``most`` with those of the others, which come first in number, and these with one another."""
    others = F.greatest(F.ceil(F.count_if(~F.col("most")) / BLOCK), F.lit(1))
    most = F.greatest(F.ceil(F.count_if("most") / BLOCK), F.lit(1))
    n_blocks = F.when(F.count("*") > BLOCK, others + most).otherwise(1).cast("int").alias("blocks")
    spread = F.when(F.col("most"), F.col("n_others") + F.pmod(F.xxhash64("node"), F.col("blocks") - F.col("n_others"))).otherwise(F.pmod(F.xxhash64("node"), F.col("n_others")))
    return _blocked(rows, key, [n_blocks, others.cast("int").alias("n_others")], spread, _upto(F.when(F.col("most"), F.col("n_others")).otherwise(F.col("blocks"))))


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Runs of rows that agree in the first ``n_keys`` columns, from rows sorted by them."""
    held: list[pa.RecordBatch] = []

    def key(b: pa.RecordBatch, i: int) -> tuple:
        return tuple(b.column(k)[i].as_py() for k in range(n_keys))

    for b in batches:
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows - 1, bool)
        for k in range(n_keys):
            c = b.column(k).to_numpy(zero_copy_only=False)
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), b.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            part = b.slice(lo, hi - lo)
            if held and key(held[-1], held[-1].num_rows - 1) != key(part, 0):
                yield pa.Table.from_batches(held)
                held = []
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def overlaps(members: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """How many values each two of the sets have in common."""
    n = len(members)
    owner = np.repeat(np.arange(n), [len(m) for m in members])
    _, value, times = np.unique(np.concatenate(members), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[value]
    owner, value = owner[keep], number[value[keep]]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    total = int(shared.sum())
    for lo in range(0, total, columns):
        a, b = np.searchsorted(value, [lo, lo + columns])
        has = np.zeros((n, min(columns, total - lo)), np.float32)
        has[owner[a:b], value[a:b] - lo] = 1
        out += has @ has.T
    return out


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links that reach every node of each component from its first one, in that order."""
    seen = ~linked.any(0)
    links: list[tuple[int, int]] = []
    for root in range(len(linked)):
        if seen[root]:
            continue
        seen[root], front = True, np.array([root])
        while len(front):
            new = np.flatnonzero(linked[front].any(0) & ~seen)
            links += zip(front[linked[np.ix_(front, new)].argmax(0)].tolist(), new.tolist(), strict=True) if len(new) else ()
            seen[new], front = True, new
    return links


def _forest(linked: np.ndarray, nodes: np.ndarray, sure: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that join each node to the smallest node of its component, alone ones left out.

    Where ``sure`` is given, components rest only on links that it confirms.
    """
    order = np.argsort(nodes)
    linked = linked[np.ix_(order, order)] & ~np.eye(len(nodes), dtype=bool)
    while True:
        links = _tree(linked)
        wrong = [(i, j) for i, j in links if not sure(order[i], order[j])] if sure else []
        if not wrong:
            break
        for i, j in wrong:
            linked[i, j] = linked[j, i] = False
    root = np.arange(len(nodes))
    for i, j in links:
        root[j] = root[i]
    apart = root != np.arange(len(nodes))
    return nodes[order][apart], nodes[order][root[apart]]


def _bridges(linked: np.ndarray, own: np.ndarray, nodes: np.ndarray, sure: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(a, b) that join what two blocks' own links leave apart; a block's own links come from its own pair of blocks."""
    inside = linked & (own[:, None] == own[None, :])
    a, b = _forest(inside, nodes, sure)
    place = {n: i for i, n in enumerate(nodes.tolist())}
    label = np.arange(len(nodes))
    label[[place[n] for n in a.tolist()]] = [place[n] for n in b.tolist()]
    names, label = np.unique(label, return_inverse=True)
    across = linked & (own[:, None] != own[None, :])
    while True:
        i, j = np.nonzero(across)
        pair = np.full((len(names), len(names)), -1)
        pair[label[i], label[j]] = np.arange(len(i))
        links = [pair[x, y] for x, y in _tree(pair >= 0)]
        wrong = [k for k in links if sure and not sure(i[k], j[k])]
        if not wrong:
            return nodes[i[links]], nodes[j[links]]
        across[i[wrong], j[wrong]] = across[j[wrong], i[wrong]] = False


def _by_estimate(group: pa.Table) -> tuple[np.ndarray, None]:
    sketch = [np.asarray(x, np.int64) for x in group["s"].to_pylist()]
    common = overlaps(sketch)
    last = np.array([s[-1] if len(s) == SKETCH else 1 << 62 for s in sketch])
    # values of either sketch up to the last value that both cover
    upto = np.stack([np.searchsorted(s, last, "right").astype(np.int32) for s in sketch])
    union = upto + upto.T - common
    return common * SKETCH >= union * _least_shared(), None


def linked_sets(one: set, two: set) -> bool:
    both = len(one & two)
    return 100 * both >= LEAST * (len(one) + len(two) - both)


def _by_sets(group: pa.Table) -> tuple[np.ndarray, Callable[[int, int], bool]]:
    """Links by the sets' hashes, and what confirms one of them on the words themselves."""
    texts = group["s"].combine_chunks()
    sets = shingle_sets(*T.flat(texts))
    common = overlaps(sets)
    size = np.array([len(s) for s in sets])

    @lru_cache(maxsize=8)
    def plain(i: int) -> set[tuple[bytes, ...]]:
        words = texts[i].as_py().split(b" ")
        return {tuple(words[k : k + WIDTH]) for k in range(max(1, len(words) - WIDTH + 1))}

    return common * 100 >= (size[:, None] + size[None, :] - common) * LEAST, lambda i, j: linked_sets(plain(int(i)), plain(int(j)))


def _linker(links: Callable[[pa.Table], tuple], own_pairs: bool):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("alone", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, 3):
            own = group["own"].to_numpy()
            linked, sure = links(group)
            nodes = group["node"].to_numpy()
            # what lies inside a block is known or comes from its own pair, where there are own pairs
            a, b = _bridges(linked, own, nodes, sure) if own_pairs and own.min() != own.max() else _forest(linked, nodes, sure)
            yield batch(schema, a, b, np.full(len(a), group["blocks"][0].as_py() == 1))

    return run


def _link(rows: DataFrame, key: str, links: Callable[[pa.Table], tuple], deal: Callable[[DataFrame, str], DataFrame] = _every_pair) -> DataFrame:
    """(a, b, alone): forests of the links within each group; ``alone`` if the group was one block."""
    keys = [key, "lo", "hi"]
    dealt = deal(rows, key).repartition(*keys).sortWithinPartitions(*keys)
    return dealt.select(*keys, "own", "blocks", "node", "s").mapInArrow(lean(_linker(links, deal is not _with_the_first)), "a long, b long, alone boolean")


def _full_texts(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(d1, d2, s) of the documents that stand for wanted classes, s the words with a space between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("s", pa.binary())])
        for b in batches:
            for _, _, data, at in T.blocks(b.column(0)):
                digests, low = _digests(data, at), T.LOWER[data]
                words, cuts = T.joined_words(low, *T.spans(low, at, T.SPACES))
                packed = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int32)), pa.py_buffer(words)])
                yield batch(schema, digests[:, 0], digests[:, 1], packed)

    keys = wanted.select(F.col("rep.id").alias("want_id"), F.col("rep.text_key").alias("want_key"))
    keys = F.broadcast(keys) if wanted.count() <= BROADCAST_IDS else keys
    wide = _wide(docs, id_col, text_col)
    found = wide.join(keys, wide["id"].eqNullSafe(keys["want_id"]) & (wide["text_key"] == keys["want_key"]), "left_semi")
    return found.select("text").mapInArrow(lean(run), "d1 long, d2 long, s binary").dropDuplicates(["d1", "d2"])


def _components(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key, n, rep) of every row; rep (no_id, id, text_key) names the first document of its component, null without words."""
    made = settled(sketches(docs, id_col, text_col))
    same = ["d1", "d2"]
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "text_key")).alias("rep")
    classes = settled(made.where("n > 0").groupBy(*same).agg(rep, F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    # the upper half of a value keeps the order and is distinct enough for an estimate
    short = classes.select("node", F.transform("sketch", lambda x: F.shiftright(x, 32).cast("int")).alias("s"))
    slots = settled(_slots(classes))
    whole = classes.select("node", F.col("sketch").alias("s"))

    def compared(lists: DataFrame, deal: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
        return _link(lists.join(whole, "node"), "value", _by_estimate, deal).select("a", "b")

    frequent = slots.where("hot")
    early = settled(_similar_pairs(slots, short).unionByName(compared(frequent.where(F.col("nth") < EARLY).select("value", "node"), _with_the_first)))
    rest = compared(_open_lists(frequent, connected(early)), _with_the_others)
    candidates = settled(connected(early.unionByName(rest)).join(classes.select("node", "rep", "n", *same), "node"))
    texts = _full_texts(docs, candidates, id_col, text_col)
    rows = candidates.select("root", "node", F.col("n").alias("weight"), *same).join(texts, same).select("root", "node", "weight", "s")
    links = settled(_link(rows, "root", _by_sets))
    roots = links.where("alone").select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(connected(links.where("not alone").select("a", "b")))
    labelled = classes.select("node", "rep", *same).join(roots.where("node <> root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = labelled.groupBy("root").agg(F.min("rep").alias("first"))
    named = settled(labelled.join(names, "root").select(*same, "first"))
    for done in (slots, early, candidates, links, classes):
        discard(done)
    return made.select("id", "text_key", "n", *same).join(named, same, "left").select("id", "text_key", "n", F.when(F.col("n") > 0, F.col("first")).alias("rep"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept is the row whose id names its component."""
    component = F.when(F.col("n") > 0, F.col("rep.id")).otherwise(F.col("id"))
    out = _components(docs, id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component, whole: the first by id, nulls last, then by a hash of the text; rows without words all stay."""
    made = _components(docs, id_col, text_col)
    first = made.where((F.col("n") == 0) | (F.col("id").eqNullSafe(F.col("rep.id")) & (F.col("text_key") == F.col("rep.text_key"))))
    keys = [F.xxhash64("id", "text_key").alias("_k1"), F.xxhash64("text_key", "id", F.lit(1)).alias("_k2")]
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    row = F.struct(*(F.col(quoted(c)) for c in docs.columns)).alias("_row")
    wide = docs.select(row, F.col(quoted(id_col)).alias("id"), F.xxhash64(text).alias("text_key")).select("_row", *keys)
    kept = wide.join(first.select(*keys, (F.col("n") == 0).alias("_empty")).distinct(), ["_k1", "_k2"])
    # rows equal in id and text are told apart by nothing but their number
    numbered = kept.withColumn("_nth", F.row_number().over(W.partitionBy("_k1", "_k2").orderBy("_k1")))
    return numbered.where("_empty or _nth = 1").select("_row.*")
