import hashlib
import json
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rillflow.llm import alignment
from rillflow.llm.bpe import _byte_chars

PATH, PATTERN, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """(ids of A, ids of B, spelling of A, spelling of B) of a text, by the libraries alone."""
    a, b = Tokenizer.from_file(PATH), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    a.encode_special_tokens = True
    chars = _byte_chars()
    with open(PATH, encoding="utf-8") as f:
        spelled = {i: bytes(chars[c] for c in p) for p, i in json.load(f)["model"]["vocab"].items() if all(c in chars for c in p)}

    def piece(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        one = [(i, spelled[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, piece(i)) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == whole == b"".join(x for _, x in two) else ([], [])

    return run


def merged(one, two):
    """Groups and links by two pointers."""
    i = j = end_a = end_b = 0
    groups, links, left, right = [], [], [], []
    while i < len(one):
        links.append((one[i][0], two[j][0]))
        a, b = end_a + len(one[i][1]), end_b + len(two[j][1])
        if a <= b:
            left.append(str(one[i][0]))
            end_a, i = a, i + 1
        if b <= a:
            right.append(str(two[j][0]))
            end_b, j = b, j + 1
        if a == b:
            groups.append(",".join(left) + "|" + ",".join(right))
            left, right = [], []
    return groups, links


def expected(rows, plain):
    made = [(i, *plain(t)) for i, t in rows]
    done = [(i, one, two, *merged(one, two)) for i, one, two in made]
    counts = Counter(link for *_, links in done for link in links)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return Counter(
        (i, len(one), len(two), len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")
        for i, one, two, groups, links in done
    )


def test_against_two_pointers(docs, awkward, plain):
    got = alignment.align(docs, PATH, PATTERN, MODEL, block_chars=5000).collect()
    assert Counter(map(tuple, got)) == expected(awkward, plain)


def test_odd_texts(spark, plain):
    rng = random.Random(9)
    kinds = ("ab ", " ", "a  \n", "éè 東🙂", "x▁ y", "<s></s><unk>", "\x00a b\t", "0123 4.5", "it's we'll ", "​　 a")
    texts = ["".join(rng.choice(k) for _ in range(n)) for k in kinds for n in (1, 2, 3, 7, 60, 900)]
    texts += ["<|endoftext|> a <|endoftext|>", "x" * 30000, " ", "  ", " a", "a ", "\n", "▁", "a▁b", "<0x41>", "́e", "ﬁ ½ Å"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(str(i), t, 1) for i, t in rows], "`a b` string, text string, block int").repartition(3)
    got = alignment.align(df, PATH, PATTERN, MODEL, id_col="a b").collect()
    want = expected([(str(i), t) for i, t in rows], plain)
    assert Counter(map(tuple, got)) == want and sum(w[1] == 0 for w in want) >= 2


def test_pair_counts_and_groups(docs, awkward, plain):
    made = alignment.blocks(docs, PATH, PATTERN, MODEL)
    counts = Counter(link for _, t in awkward for link in merged(*plain(t))[1])
    got = {(r.a, r.b): (r.n, r.best_a, r.best_b) for r in alignment.pair_counts(made).collect()}
    assert {k: v[0] for k, v in got.items()} == counts
    for (a, b), (n, best_a, best_b) in got.items():
        assert best_a == (n == max(m for (x, _), m in counts.items() if x == a))
        assert best_b == (n == max(m for (_, y), m in counts.items() if y == b))
    spelt = Counter((r.doc_id, r.groups) for r in alignment.groups(docs, PATH, PATTERN, MODEL).collect())
    assert spelt == Counter((i, ";".join(merged(*plain(t))[0])) for i, t in awkward)


def test_empty_table(nothing):
    assert alignment.align(nothing, PATH, PATTERN, MODEL).count() == 0
