import random
import re
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import near_dedup as N
from rillflow.llm.components import connected


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    ids = {}
    for i, (doc, _) in enumerate(rows):
        ids.setdefault(find(i), []).append(doc)
    for i, (doc, _) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        component = min(known) if known else None
        yield doc, len(sets[i]), component if sets[i] else doc, (component if sets[i] else doc) == doc


def corpus(seed, groups=25):
    """Exact copies, near copies on both sides of the threshold, chains, and lines that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    line = " ".join(word() for _ in range(25))
    texts = []
    for g in range(groups):
        base = [word() for _ in range(rng.choice([3, 6, 12, 30, 60, 90, 200, 400]))]
        for _ in range(rng.choice([1, 2, 3, 30])):
            copy = base[:]
            for _ in range(rng.choice([0, 0, 1, 2, len(base) // 40, len(base) // 25])):
                copy[rng.randrange(len(copy))] = word()
            texts.append((line + " " if g % 4 == 0 else "") + " ".join(copy).upper() if g % 3 else " ".join(copy))
            if g % 5 == 0:
                base = copy
    rng.shuffle(texts)
    return list(zip(rng.sample(range(10_000), len(texts)), texts, strict=True))


@pytest.mark.parametrize(("seed", "block", "cold"), [(1, 512, 16), (2, 7, 2)])
def test_against_all_pairs(spark, awkward, monkeypatch, seed, block, cold):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "COLD", cold)
    rows = corpus(seed) + list(awkward) + [(None, "only null ids have this text here"), (None, "only null ids have this text here")]
    table = spark.createDataFrame(rows, "id long, text string").selectExpr("id as doc_id", "text", "1 as n", "2 as node", "3 as root", "'x' as s").repartition(4)
    assert Counter(map(tuple, N.near_duplicates(table).collect())) == Counter(plain(rows))


def test_large_ids_join_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(N, "BROADCAST_IDS", -1)
    rows = corpus(3, 12)
    assert Counter(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == Counter(plain(rows))


def morse(n, flip):
    """Two such words differ at every place, but a polynomial hash modulo a power of two can't tell them apart."""
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


def test_words_that_fool_a_polynomial_hash(spark):
    rows = [(2 * n + f, " ".join(morse(size, f) for _ in range(6))) for n, size in enumerate((1024, 2048, 4096)) for f in (0, 1)]
    assert Counter(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == Counter(plain(rows))


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """With a hash that takes all words of one length for the same, only the words themselves can tell."""
    monkeypatch.setattr(N.T, "word_hashes", lambda data, starts, ends: N.T.mix((ends - starts).astype(np.uint64)))
    rng = random.Random(11)
    group = [bytes(" ".join(rng.choice(["aa", "bb", "cc"]) for _ in range(12)), "ascii") for _ in range(8)]
    group[3], group[6] = group[1], group[1] + b" aa"
    table = N.pa.table({"s": N.pa.array(group, N.pa.binary())})
    linked, sure = N._by_sets(table)
    a, b = N._forest(linked, np.arange(8), sure)
    want = {(r, c) for i, (r, _, c, _) in enumerate(plain([(n, t.decode()) for n, t in enumerate(group)])) if r != c}
    assert linked[0].sum() > 1 and set(zip(a.tolist(), b.tolist(), strict=True)) == want and want


def test_frequent_values_beyond_the_early_ones(spark, monkeypatch):
    """Texts that share what is frequent with many others, and only later values with their own copies."""
    for name, value in (("EARLY", 1), ("COLD", 1), ("BLOCK", 5)):
        monkeypatch.setattr(N, name, value)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    parts = [[word() for _ in range(60)] for _ in range(6)]
    rows = []
    for n in range(160):
        base = sum(rng.sample(parts, 2), [])
        for _ in range(rng.choice([0, 1, 3, 30])):
            base[rng.randrange(120)] = word()
        rows.append((n, " ".join(base)))
    assert Counter(map(tuple, N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())) == Counter(plain(rows))


def test_one_row_of_each_component_stays(spark, awkward):
    rows = corpus(4, 8)
    rows += [(None, rows[0][1]), (None, rows[0][1]), (None, "no other text has these six words"), (None, "no other text has these six words"), (rows[5][0], rows[5][1]), (9, ""), (9, ""), (10, None)]
    table = spark.createDataFrame(rows, "id long, text string").selectExpr("id as doc_id", "text", "1 as n", "2 as `_k1`", "3 as `a b`")
    got = N.keep_first(table)
    assert got.columns == table.columns
    kept, seen = [], set()
    roots = list(plain(rows))
    for (i, n, c, k), (_, t) in sorted(zip(roots, rows, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)):
        if not n:
            kept.append((i, t))
        elif k and (key := (c, "" if c is not None else t)) not in seen:
            seen.add(key)
            kept.append((i, t))
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter(kept)


def test_empty_table(nothing):
    assert N.near_duplicates(nothing).count() == 0 and N.keep_first(nothing).count() == 0


def test_overlaps():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 60, n)) for n in (1, 5, 40, 40, 100)] + [np.array([1000])]
    want = [[len(np.intersect1d(a, b)) if i != j else None for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    got = N.overlaps(sets, columns=7)
    assert all(got[i, j] == want[i][j] for i in range(6) for j in range(6) if i != j)


def test_bridges_between_blocks():
    rng = np.random.default_rng(3)
    for chance in (0.0, 0.02, 0.05, 0.3):
        linked = np.triu(rng.random((40, 40)) < chance, 1)
        linked |= linked.T
        false = np.triu(rng.random((40, 40)) < 0.2, 1)
        sure = lambda i, j: not (false | false.T)[i, j]  # noqa: E731, B023
        nodes, own = rng.permutation(40) + 100, np.arange(40) % 2
        parts = [N._bridges(linked, own, nodes, sure)] + [N._forest(linked[np.ix_(own == k, own == k)], nodes[own == k], lambda i, j, k=k: sure(2 * i + k, 2 * j + k)) for k in (0, 1)]
        got = N._forest(np.isin(np.arange(1600), [np.flatnonzero(nodes == a)[0] * 40 + np.flatnonzero(nodes == b)[0] for x in parts for p in (x, x[::-1]) for a, b in zip(*p, strict=True)]).reshape(40, 40), nodes)
        want = N._forest(linked & ~(false | false.T), nodes)
        assert set(zip(*got, strict=True)) == set(zip(*want, strict=True)) and sum(len(x[0]) for x in parts) <= 39


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 90), (90, 95), (7, 7), (95, 100), (100, 90)] + [(200, i) for i in range(201, 260)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {i: 90 for i in (90, 95, 100)} | {i: 200 for i in range(200, 260)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_words_made_to_collide_count_apart(spark):
    """Two words of 16 bytes that a hash by steps of eight bytes took for one."""
    texts = [f"one two three four {w} one two three four {v}" for w, v in (("aaaaaaaabbbbbbbb", "f6x30bmo<bj04uc3"), ("aaaaaaaabbbbbbbb", "aaaaaaaabbbbbbbb"))]
    got = N.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_shingles for r in got} == {0: 6, 1: 5}
