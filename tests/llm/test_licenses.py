import random
import re

import pyarrow as pa
import pytest

from rillflow.llm import licenses as L
from rillflow.llm.text import blocks


def split(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def nearest(template, words):
    """Fewest edits over every part of the words, by the textbook recurrence; the earliest start, then the earliest end."""
    best = None
    for start in range(len(words) + 1):
        row = list(range(len(words) - start + 1))
        for i, t in enumerate(template, 1):
            new = [i]
            for j, w in enumerate(words[start:], 1):
                new.append(min(row[j - 1] + (t != w), row[j] + 1, new[j - 1] + 1))
            row = new
        for j, cost in enumerate(row):
            if best is None or cost < best[0]:
                best = (cost, start, start + j)
    return best


def plain(text, templates):
    """Every template against the whole text, best first, as long as something fits; no compression, no blocks."""
    out, todo = [], [(0, split(text))]
    while todo:
        lo, part = todo.pop()
        found = []
        for name, wordings in templates.items():
            for wording in wordings:
                t = split(wording)
                if not part or len(set(t) & set(part)) < len(set(t)) - len(t) // 5:
                    continue
                edits, a, z = nearest(t, part)
                if edits <= len(t) // 5:
                    found.append((edits / len(t), -len(t), a, z, edits, name))
        if found:
            _, _, a, z, edits, name = min(found)
            out.append((name, lo + a, lo + z, edits))
            todo += [(lo, part[:a]), (lo + z, part[z:])]
    return sorted(out, key=lambda x: x[1])


SHORT = {k: tuple(w for w in v if len(split(w)) < 40) for k, v in L.TEMPLATES.items()}


def test_against_every_template(spark, docs, awkward, nothing):
    rng = random.Random(9)
    fill = lambda: " ".join(rng.choice(["alpha", "license", "under", "the", "zeta", "version"]) for _ in range(rng.randint(0, 12)))
    texts = []
    for wordings in SHORT.values():
        for w in wordings:
            changed = w.split()
            changed[rng.randrange(len(changed))] = "other"
            texts += [w, f"{fill()}\n{w.upper()}\n{fill()}", f"{fill()} {' '.join(changed)} {fill()}", " ".join(w.split()[: len(w.split()) // 2])]
    texts += [f"{L.TEMPLATES['MIT'][1]} {fill()} {L.TEMPLATES['CC-BY-4.0'][0]}", None, "", "license"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [(n.license, n.start, n.end, n.differences) for n in r.notices] for r in L.find_licenses(rows, templates=SHORT).collect()}
    assert got == {i: plain(t, SHORT) for i, t in enumerate(texts)}
    assert L.find_licenses(docs).count() == len(awkward) and L.find_licenses(nothing).count() == 0


def test_whole_licenses(spark):
    """Each license as it stands, and with a tenth of its words dropped, changed or added; texts that hold several; texts that hold none."""
    rng = random.Random(10)
    want, texts = [], []
    for name, wordings in L.TEMPLATES.items():
        whole = wordings[0]
        words = whole.split()
        for _ in range(len(words) // 10):
            k = rng.randrange(len(words))
            words[k : k + 1] = rng.choice([[], ["changed"], [words[k], "added"]])
        for text in (whole, "Copyright (c) 2020 Someone\n\n" + whole.replace(" ", "\n", 9) + "\n\nint main() {}", *([" ".join(words)] if len(words) > 60 else [])):
            texts.append(text)
            want.append([name])
    texts.append("\n--\n".join(L.TEMPLATES[k][0] for k in ("MIT", "ISC", "Zlib", "BSD-2-Clause")) + " tail")
    want.append(["MIT", "ISC", "Zlib", "BSD-2-Clause"])
    texts += [" ".join(rng.sample(L.TEMPLATES[k][0].split(), 60)) for k in ("MIT", "BSL-1.0", "GPL-3.0")]
    want += [[], [], []]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id as `a b`", "text")
    got = {r["a b"]: [n.license for n in r.notices] for r in L.find_licenses(rows, "a b").collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_the_ranking_decides_what_is_confirmed(monkeypatch):
    scanner = L.Scanner(L.TEMPLATES)
    tried = []
    monkeypatch.setattr(L, "differences", lambda t, b, f=L.differences: tried.append(len(t)) or f(t, b))
    block = [w.encode() for w in split(L.TEMPLATES["MIT"][0])]
    saved = scanner.ranking(block)
    assert len(saved) == 3 and saved[0][1].license_id == "MIT" and saved[0][0] > saved[1][0] + L.MARGIN
    assert scanner.winner(block)[3:] == (len(block), 0, "MIT") and tried == [len(block)]
    # a ranking that takes another template for the winner gives that one, as long as its wording is confirmed
    monkeypatch.setattr(scanner, "ranking", lambda part: [(100, saved[1][1]), (10, saved[0][1])])
    assert scanner.winner(block)[1] == -len(saved[1][1].words)


def test_work_grows_with_the_text():
    """A text made of nothing but words that could open a notice is cut to blocks of one size."""
    text = "licensed under the software permission " * 20_000
    scanner = L.Scanner(L.TEMPLATES)
    for _, _, data, at in blocks(pa.array([text])):
        found = list(scanner.blocks(L._Docs(data, at)))
    assert max(z - a for a, z in found) == 2 * scanner.longest and len(found) == pytest.approx(100_000 / scanner.longest, abs=2)
    assert all(b[0] <= a[1] - scanner.longest for a, b in zip(found[:-1], found[1:], strict=True)) and found[-1][1] == 100_000


def test_differences():
    assert L.differences("a b c".split(), "x a b c y".split()) == (0, 1, 4)
    assert L.differences("a b c d".split(), "a c d".split()) == (1, 0, 3)
    assert L.differences("a b".split(), "q".split())[0] == 2
    rng = random.Random(1)
    for _ in range(200):
        t, b = ([rng.choice("abcd") for _ in range(rng.randint(1, 7))] for _ in range(2))
        edits, start, end = L.differences(t, b)
        want = nearest(t, b)
        assert edits == want[0] and nearest(t, b[start:end])[0] == edits
