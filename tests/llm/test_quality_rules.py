import re
from collections import Counter

import pyarrow as pa

from rillflow.llm import quality_rules as Q


def measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    repeated = {p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 5)}
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    chars, symbols, dups = sum(map(len, words)), sum(c in Q.SYMBOLS for c in text), len(lines) - len(set(lines))
    upper, letters, bangs = (len(re.findall(p, text)) for p in ("[A-Z]", "[A-Za-z]", "!"))
    bad = 10 * symbols > len(words) or not 2 * len(words) <= chars <= 15 * len(words) or 10 * dups > 3 * (text.count("\n") + 1) or 2 * upper > max(1, letters) or 5 * bangs > len(words)
    return len(words), chars, symbols, dups, len(repeated), failed, not failed and not bad


def test_against_plain_python(docs, awkward):
    got = Counter(map(tuple, Q.score_rules(docs).collect()))
    assert got == Counter((i, *measures(t)) for i, t in awkward)


def test_filter_keeps_rows_whole(docs, awkward):
    got = Counter(r.source for r in Q.keep_good(docs).collect())
    assert got == Counter(f"s{n}" for n, (_, t) in enumerate(awkward) if measures(t)[-1])
    assert Q.keep_good(docs).columns == docs.columns


def test_order_does_not_change_verdicts(awkward):
    texts = pa.array([t for _, t in awkward], pa.string())
    rules = Q.BASE_RULES + Q.MORE_RULES
    for _, _, data, at in Q.T.blocks(texts, 4000):
        results = {tuple(Q.passes(Q.Texts(data, at), order).tolist()) for order in (rules, rules[::-1], Q.ranked(rules, Q.trial(texts, rules)))}
        assert len(results) == 1


def test_cascade_prefers_rejections_per_cost():
    texts = pa.array(["###" * 50] * 300 + ["some plain words of text " * 20] * 10)
    trials = Q.trial(texts, Q.MORE_RULES, ["_words", "n_words", "n_symbols"])
    assert [t[1:] for t in trials] == [(300, 310), *[(n, 310) for n in (300, 0, 0, 0)]]
    assert Q.ranked(Q.MORE_RULES, trials)[0].name in ("symbols", "word_length")
    assert [r.name for r in Q.ranked(Q.MORE_RULES, [(1, 5, 9), (1, 9, 9), (4, 9, 9), (1, 0, 9), (9, 9, 9)])] == ["word_length", "symbols", "repeated_lines", "exclamations", "capitals"]


def test_rules_are_tried_where_the_rows_are(docs):
    assert sorted(r.name for r in Q.order_rules(docs, Q.MORE_RULES)) == sorted(r.name for r in Q.MORE_RULES)


def test_lines_and_words_that_fool_a_hash(spark, monkeypatch):
    """Words that a polynomial hash can't tell apart, and a hash that can't tell any two of one length apart."""
    morse = lambda n, flip: "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))
    texts = [sep.join(morse(size, f) for f in (0, 1, 0, 0, 1)) for size in (1024, 2048, 4096) for sep in ("\n", " ", "\n ")]
    texts += ["aa bb cc dd ee ff " * 3 + "aa bb cc dd ef fe", "aa\nbb\naa\n\n \nbb\x1c\nbb", "a\u2003b\u00a0c d e f g\x1fh " * 4, "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert Counter(map(tuple, Q.score_rules(rows).collect())) == Counter((i, *measures(t)) for i, t in enumerate(texts))
    monkeypatch.setattr(Q.T, "word_hashes", lambda data, starts, ends: Q.T.mix((ends - starts).astype("uint64")))
    for _, _, data, at in Q.T.blocks(pa.array(texts, pa.string())):
        x = Q.Texts(data, at)
        assert [(a, b) for a, b in zip(x["n_dup_lines"].tolist(), x["n_repeat_words"].tolist(), strict=True)] == [measures(t)[3:5] for t in texts]


def test_empty_table(nothing):
    assert Q.score_rules(nothing).count() == 0 and Q.keep_good(nothing).count() == 0
