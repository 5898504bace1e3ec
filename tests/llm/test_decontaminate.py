import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from rillflow.llm import decontaminate as D


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, width=10):
    windows = []
    for item, text in items:
        w = words(text)
        windows += [(str(item).lower() if item is None else str(item), w[i : i + width]) for i in range(max(1, len(w) - width + 1) if w else 0)]
    windows = [("null" if i == "none" else i, w) for i, w in windows]
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for item, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    found.add(item)
        yield doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def items():
    rng = random.Random(5)
    vocabulary = ["the", "a", "of", "Rain", "sun", "éau", "7", "x9", "tree"]
    long = [" ".join(rng.choice(vocabulary) for _ in range(n)) for n in (30, 25, 11, 10)]
    return [*enumerate(long), (4, long[0]), (5, "Only-three Words"), (6, "one"), (7, "two words"), (8, ""), (9, None), (10, "!!"), (None, "null item has these five"), (10, long[1] + " " + long[2])]


@pytest.mark.parametrize("size", [0, 1 << 20])
def test_against_every_window(spark, docs, awkward, items, monkeypatch, size):
    monkeypatch.setattr(D, "BROADCAST_WINDOWS", size)
    monkeypatch.setattr(D, "BROADCAST_BYTES", size)
    rng = random.Random(8)
    rows = list(awkward)
    for n in range(60):
        a = rng.choice([t for _, t in items if t])
        w = a.split()
        i = rng.randrange(len(w))
        rows.append((1000 + n, f"{rng.choice(['', 'the of a '])}{', '.join(w[i : i + rng.choice([9, 10, 14])])} {rng.choice(['tail', '', 'ONE', 'null item has these five'])}"))
    table = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n_words", "text as hit_words", "2 as k1", "3 as `a b`", "4 as kept", "5 as items")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = D.find_leaks(table, bench, keep=["a b", "items", "hit_words", "kept", "n_words", "text"] if size else ())
    assert found.columns == ["doc_id", *(["a b", "hit_words", "kept", "text"] if size else []), "n_words", "n_hit", "hit_spans", "items"]
    found = found.cache()
    assert not size or found.where("`a b` <> 3 or kept <> 4 or not (text <=> hit_words)").count() == 0
    got = [(r.doc_id, r.n_words, r.n_hit, len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r.n_hit > 0) for r in found.collect()]
    assert Counter(got) == Counter(plain(rows, items))
    if size:
        assert Counter(map(tuple, D.leak_report(table, bench).collect())) == Counter(got)


def test_spans(spark):
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x a b c a b c y a b c")], "doc_id long, text string")
    assert D.find_leaks(rows, bench).first().hit_spans == [1, 7, 8, 11]


def test_filter_passes_what_it_holds(spark, monkeypatch):
    monkeypatch.setattr(D, "FILTER_BITS", 1 << 13)
    rng = np.random.default_rng(2)
    inside, outside = (rng.integers(-(1 << 63), 1 << 63, 400) for _ in range(2))
    look = D.Filter(spark.createDataFrame([(int(x),) for x in inside], "shingle long"))
    assert look.n_bits == 1 << 13 and len(look.passed(inside)) == 400 and len(look.passed(outside)) < 40


def test_empty_tables(spark, docs, nothing):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert D.leak_report(docs, none).where("contaminated").count() == 0
    assert D.leak_report(nothing, some).count() == 0
