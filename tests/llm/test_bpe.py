import hashlib
import random
import struct
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import bpe, token_counts

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digests(library, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


@pytest.mark.parametrize("segment", [64, 1000, bpe.SEGMENT])
def test_round_trip_is_the_librarys(docs, awkward, library, segment):
    got = bpe.round_trip(docs, PATH, PATTERN, segment=segment).collect()
    want = Counter((i, *digests(library, t)) for i, t in awkward)
    assert Counter(map(tuple, got)) == want


def test_encode_and_decode(docs, awkward, library):
    ids = bpe.encode(docs, PATH, PATTERN, keep=("source",), segment=200)
    back = {r.source: r.text for r in bpe.decode(ids, PATH, PATTERN, keep=("source",)).collect()}
    assert back == {f"s{n}": t or "" for n, (_, t) in enumerate(awkward)}
    assert bpe.decode(ids.withColumn("ids", F.lit(None).cast("array<int>")), PATH, PATTERN, keep=("source",)).where("text != ''").count() == 0


KINDS = ("abc", "theing", "=-", "aé", "0123456789", " \n", "etaoinshrdlu", "a b", " a", "it's we'll 're ", "a 1 .\n ", "東京🙂 é")


def test_texts_cut_anywhere(library):
    rng, c = random.Random(3), bpe.codec(PATH, PATTERN)
    for kind in KINDS:
        for n in (5, 40, 700):
            text = "".join(rng.choice(kind) for _ in range(n))
            want = library.encode(text, add_special_tokens=False).ids
            for most in (1, 3, 17, 100):
                for window in (1, 2, 16):
                    nodes = [bpe.leaf(text[i : i + most], c) for i in range(0, n, most)]
                    assert bpe.tree(nodes, c, window).ids == want


def test_sure_splits_are_splits(library):
    rng, c = random.Random(4), bpe.codec(PATH, PATTERN)
    assert c.usual
    for kind in KINDS:
        text = "".join(rng.choice(kind) for _ in range(300))
        at = c.sure_split(text)
        assert at is None or at in {a for a, _, _ in c.pre_tokens(text)} and at <= 300 - c.margin
        node = bpe.leaf(text, c)
        assert node.ids == library.encode(text, add_special_tokens=False).ids and (at is None or c.spell(node.ids[-node.tail :]).decode() == text[at:])


def test_special_strings_across_cuts(library):
    c = bpe.codec(PATH, PATTERN)
    for text in ("<|endoftext|>" * 3, "a<|endoftext|> b", "x <|endoftext|><|endoftext|", "  <|endoftext|>\n\n<|endoftext|>'s", "<|endof<|endoftext|>text|>"):
        want = library.encode(text, add_special_tokens=False).ids
        for a in range(len(text) + 1):
            for b in range(a, len(text) + 1):
                nodes = [bpe.leaf(x, c) for x in (text[:a], text[a:b], text[b:])]
                assert bpe.tree(nodes, c, 1).ids == want


def test_ids_stay_outside_the_window():
    c = bpe.codec(PATH, PATTERN)
    encoded = []
    c_part, c.part = c.part, lambda text, special: encoded.append(text) or c_part(text, special)
    try:
        sides = [bpe.leaf("some words of text and more of them " * 200, c) for _ in range(2)]
        del encoded[:]
        assert len(bpe.concatenate(*sides, c).ids) > 3000 and len(encoded) < 10
        sides = [bpe.leaf("xyz" * 3000, c) for _ in range(2)]
        del encoded[:]
        bpe.concatenate(*sides, c)
        assert encoded == []  # one pre-token, joined inside
    finally:
        del c.part


def test_long_documents_are_joined_level_by_level(spark, library):
    """A table like ``documents``: each text of more than a segment makes one join less than it has pieces."""
    rows = [(n, " ".join(f"word{k * n % 97}" for k in range(n * 300))) for n in range(12)] + [(12, "z" * 20_000), (None, "q " * 9_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nodes = bpe.pieces(docs, PATH, PATTERN, segment=1024)
    long = [t for _, t in rows if len(t) > 1024]
    assert nodes.count() == sum(-(-len(t) // 1024) for t in long)
    levels = [nodes.count() - len(long)]
    while nodes.where("n > 1").count():
        nodes = bpe.settled(bpe.join_level(nodes, PATH, PATTERN))
        levels.append(nodes.count() - len(long))
    assert levels[0] > 100 and len(levels) == 3 and levels[-1] == 0
    got = Counter((r.kept.doc_id, tuple(bpe.unpacked(r.ids, bpe.codec(PATH, PATTERN)))) for r in nodes.collect())
    assert got == Counter((i, tuple(library.encode(t, add_special_tokens=False).ids)) for i, t in rows if len(t) > 1024)


def test_same_ids_for_every_character(library):
    c = bpe.codec(PATH, PATTERN)
    chars = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(f"a{x}1{x} " for x in chars[i : i + 50]) for i in range(0, 0x3400, 50)]
    assert [c.encode(t) for t in texts] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(nothing):
    assert bpe.round_trip(nothing, PATH, PATTERN).count() == 0
    assert token_counts.count_tokens(nothing, PATH, PATTERN).count() == 0


@pytest.mark.parametrize("block", [100, token_counts.BLOCK_CHARS])
def test_token_counts_are_the_librarys(docs, awkward, library, block):
    got = token_counts.count_tokens(docs, PATH, PATTERN, block_chars=block).collect()
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in awkward)
    assert Counter(map(tuple, got)) == want
