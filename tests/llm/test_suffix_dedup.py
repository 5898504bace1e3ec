import random
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from rillflow.llm import suffix_dedup as S


def plain(rows, length=S.LENGTH):
    """Every string of the corpus in document order; rows equal in id and text are one document."""
    order = sorted({(i is not None, i or 0, S_hash(t), t or "") for i, t in rows})
    seen, spans = set(), {}
    for has_id, i, _, t in order:
        raw = t.encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = True
            seen.add(s)
        spans[(i if has_id else None, t)] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), bytes(np.frombuffer(raw, np.uint8)[~gone]))
    return [(i, *spans[i, t or ""]) for i, t in rows]


_HASHES: dict[str, int] = {}


def S_hash(t):
    return _HASHES[t or ""]


def learn_hashes(spark, rows):
    texts = sorted({t or "" for _, t in rows})
    for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "xxhash64(t) as h").collect():
        _HASHES[r.t] = r.h


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passages = [some(n) for n in (14, 20, 25, 40, 80)]
    texts = [some(rng.choice([3, 30, 90])) + rng.choice(["", " "]) + rng.choice(passages) + some(rng.choice([1, 30])) for _ in range(60)]
    texts += [passages[1] * 3, "ab" * 400, "ba" * 300, "x" * 99, "x" * 100, "x" * 101, "x" * 500, "\0" * 300, "\0" * 120 + "a", some(60), texts[0], texts[0], texts[1][50:], passages[4][3:-5]]
    rows = [(rng.randrange(40), t) for t in texts] + [(None, texts[2]), (None, texts[3][1:]), (7, None), (8, ""), (9, texts[0]), (9, texts[0])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_every_string(spark, awkward, seed):
    rows = corpus(seed) + list(awkward)
    learn_hashes(spark, rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as text_key", "3 as place", "4 as `row`", "5 as `a b`", "6 as `c.d``e`").repartition(5)
    got = Counter((*r[:4], bytes(r[4])) for r in S.measure_repeats(table).collect())
    assert got == Counter(plain(rows))
    cut = Counter((r.doc_id, r.text, r.id, r.row) for r in S.cut_repeats(table).collect())
    assert cut == Counter((p[0], None if t is None else p[4].decode("utf-8", "ignore"), 1, 4) for p, (_, t) in zip(plain(rows), rows, strict=True))


def test_one_passage_over_many_tasks(spark):
    line = " ".join(f"w{n}" for n in range(60))
    rows = [(n, f"{n * 7919} {line} {n * 104729} tail") for n in range(400)]
    learn_hashes(spark, rows)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = Counter((*r[:4], bytes(r[4])) for r in S.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert got == Counter(plain(rows))


def test_ranges_that_are_coalesced(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(220)) for _ in range(40)]
    rows = [(n, f"{rng.random()} {lines[n % 40][rng.randrange(9):]} {rng.random()} tail") for n in range(1200)]
    learn_hashes(spark, rows)
    conf = {"spark.sql.adaptive.enabled": "true", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = Counter((*r[:4], bytes(r[4])) for r in S.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect())
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert got == Counter(plain(rows))


def test_long_texts_are_whole(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 700)
    parts = list(S._pieces(S.pa.array(["a" * 500, "b" * 3000, None, "c" * 800])))
    assert [(lo, len(d), s) for lo, d, _, s in parts] == [(0, 500, 0), (1, 799, 0), (1, 799, 700), (1, 799, 1400), (1, 799, 2100), (1, 200, 2800), (3, 799, 0), (3, 100, 700)] or len(parts) > 4
    starts = {(lo, s + p) for lo, d, _, s in parts for p in range(len(d) - S.LENGTH + 1)}
    assert {p for lo, p in starts if lo == 1} == set(range(2901))


def test_passages_at_the_parts_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "STEP", 700)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    rows = []
    for n in range(60):
        passage, at = some(rng.randint(100, 167)), 700 * rng.randint(1, 3)
        at += rng.randint(0, 5) if n % 2 else 99 + rng.randint(0, 5) - len(passage)
        rows += [(2 * n, some(at) + passage + some(rng.randint(300, 900))), (2 * n + 1, some(rng.randint(0, 2000)) + passage + some(40))]
    whole = some(799) + rows[0][1][-1]
    rows += [(200, whole), (200, whole), (None, whole)]
    learn_hashes(spark, rows)
    cloudpickle.register_pickle_by_value(S)  # so that the workers see the small STEP
    try:
        got = Counter((*r[:4], bytes(r[4])) for r in S.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(S)
    assert got == Counter(plain(rows))


@pytest.mark.parametrize("chunk", [1, 50])
def test_ranges_and_buckets_a_few_leads_at_a_time(spark, monkeypatch, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    monkeypatch.setattr(S, "HELD", 100)
    rows = corpus(9)
    learn_hashes(spark, rows)
    cloudpickle.register_pickle_by_value(S)
    try:
        got = Counter((*r[:4], bytes(r[4])) for r in S.measure_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    finally:
        cloudpickle.unregister_pickle_by_value(S)
    assert got == Counter(plain(rows))


def test_multikey_order():
    rng = np.random.default_rng(4)
    rows = rng.integers(0, 2, (300, 24)).astype(np.uint8)
    rows[:100, :16] = 0
    got = rows[S.multikey_order(rows)]
    assert [r.tobytes() for r in got] == sorted(r.tobytes() for r in rows)


def test_equal_strings_name_equal_suffixes():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 100, 300).astype(np.uint8)
    sides = [rng.integers(97, 100, n).astype(np.uint8) for n in (50, 333, 77, 12)]
    found = []
    for a, z in ((0, 1), (2, 3)):
        data = np.concatenate([sides[a], passage, sides[z]])
        _, _, place, near, far = S.named_suffixes(data, np.array([0, len(data)]))
        found.append({(p - k - len(sides[a]), p - len(sides[a])) for p, n, f in zip(place, near, far, strict=True) for k in range(n, f + 1) if 0 <= p - k - len(sides[a]) <= 200})
    assert found[0] == found[1] and len(found[0]) == 201


def test_empty_table(nothing):
    assert S.measure_repeats(nothing).count() == 0 and S.cut_repeats(nothing).count() == 0
