import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from rillflow.llm import spelling


def counted(rows, altered=31, least=7):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % altered == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            if len(run) >= least:
                out[run] += 1
    return {w: n for w, n in out.items() if n >= 2}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(words, ratio=10):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def texts(seed, n):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abeéÿÀ") for _ in range(rng.randrange(6, 11))) for _ in range(25)] + ["aaaaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(60):
            w = stems[int(rng.random() ** 3 * len(stems))]
            if rng.random() < 0.3:
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abc") + w[k:], w[:k] + rng.choice("abc") + w[k + 1 :]])
            words.append(rng.choice([w, w, w.upper(), w.capitalize()]))
        rows.append((i if i % 9 else None, rng.choice([" ", "1", "-", "\n"]).join(words)))
    return rows


@pytest.mark.parametrize("altered", [31, 3])
def test_against_all_pairs(spark, altered):
    rows = texts(altered, 120) + [(5, None), (6, ""), (7, "x" * 3000), (8, "x" * 2999 + " " + "x" * 3000), (9, "x" * 2999)]
    df = spark.createDataFrame([(i, t, "word", 1, "id") for i, t in rows], "doc_id long, text string, word string, n int, id string").repartition(5)
    want = grouped(counted(rows, altered))
    got = spelling.group_variants(df, altered=altered).collect()
    assert len(got) == len(want) and {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got} == want
    assert any(f is not None for _, f, *_ in want)


def test_chains_of_forms_end_at_the_last(spark):
    chain = ["aaaaaaaaaa", "aaaaaaaaab", "aaaaaaaabb", "aaaaaaabbb", "aaaaaabbbb"]
    words = spark.createDataFrame(list(zip(chain, chain[1:], strict=False)), "word string, form string")
    assert {r.word: r.root for r in spelling._roots(words).collect()} == dict.fromkeys(chain[:-1], chain[-1])


def test_keys_are_those_of_the_deleted_words():
    words = ["abcdefg", "aabbaab", "zzzzzzz", "éÿàéÿàé", "x" * 500]
    word, place, first, key = spelling.deletion_keys(words)
    of = {}
    for w, p, f, k in zip(word.tolist(), place.tolist(), first.tolist(), key.tolist(), strict=True):
        rest = words[w] if p < 0 else words[w][:p] + words[w][p + 1 :]
        assert of.setdefault(rest, k) == k
        assert f == (p <= 0 or words[w][p] != words[w][p - 1])
    assert len(set(of.values())) == len(of)
    assert {k for w, k in zip(word.tolist(), key.tolist(), strict=True) if w == 0} >= set(spelling.deletion_keys(["bcdefg"])[3][:1].tolist())


def test_equal_hashes_of_other_words_decide_nothing(spark, monkeypatch):
    rows = texts(11, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = spelling.deletion_keys

    def few(batches):
        monkey = spelling.deletion_keys
        spelling.deletion_keys = lambda words: (*real(words)[:3], real(words)[3] % np.uint64(7))
        try:
            yield from keys(batches)
        finally:
            spelling.deletion_keys = monkey

    keys = spelling._keys
    words = spark.createDataFrame([(i, w, n) for i, (w, n) in enumerate(counted(rows).items())], "id long, word string, n long")
    want = {(r.id, r.n_near, r.best) for r in spelling.near_words(words).collect()}
    monkeypatch.setattr(spelling, "_keys", few)
    assert {(r.id, r.n_near, r.best) for r in spelling.near_words(words).collect()} == want and len(want) > 50
    assert df.count() == 40


def test_runs_go_on_over_batches():
    import pyarrow as pa

    rng = random.Random(2)
    rows = sorted((rng.randrange(40), rng.choice([-1, 0, 1, 2]), i, rng.random() < 0.8) for i in range(300))
    rows = [r for r in rows if r[1] >= 0 or r[3]]
    def run(step):
        parts = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = [pa.RecordBatch.from_arrays([pa.array([r[j] for r in p], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.bool_()))], names=list("abcd")) for p in parts]
        return [tuple(r.values()) for b in spelling._shared(iter(batches)) for r in b.to_pylist()]

    whole, by_key = run(1000), defaultdict(list)
    assert sorted(whole) == sorted(run(7)) == sorted(run(1))
    for r in rows:
        by_key[r[0]].append(r)
    want = []
    for group in by_key.values():
        for _, place, i, first in group:
            replaced = place >= 0 and sum(p == place for _, p, _, _ in group) > 1
            inserted = first and len(group) > 1 and any(p == -1 for _, p, _, _ in group)
            if replaced or inserted:
                want.append((place, i, replaced, inserted))
    assert sorted(whole) == sorted(want)


def test_empty_table(nothing):
    assert spelling.group_variants(nothing).count() == 0
