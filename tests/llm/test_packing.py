import random
import struct
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rillflow.llm import packing
from rillflow.llm.word_codec import PLAIN, word_codec

PATH = public_tokenizers.path("word_bpe_49k.json")
END = 2


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def held(rows, texts, library, longest):
    """Every id of every text lies in one piece, and pieces tile their sequences."""
    by_row, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_row[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_row) == set(texts)
    for i, text in texts.items():
        ids = [*library.encode(text or "", add_special_tokens=False).ids, END]
        at = 0
        for r in sorted(by_row[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert bytes(r.ids) == struct.pack(f"<{r.length}I", *ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        # no sequence is padded: each is as long as its tier, or a power of two where the last window was cut
        assert at == pieces[0].tier <= longest and at & (at - 1) == 0
        assert len({(r.tier, r.step) for r in pieces}) == 1
    return by_sequence


@pytest.mark.parametrize(("tiers", "step"), [((512, 1024, 2048, 4096), 1 << 18), ((8, 16, 64), 128)])
def test_pieces_tile_documents_and_sequences(docs, awkward, library, tiers, step):
    got = packing.pack(docs.withColumn("id", F.col("source")), PATH, END, id_col="id", tiers=tiers, step_tokens=step).withColumnRenamed("id", "doc_id").collect()
    sequences = held(got, {f"s{n}": t for n, (_, t) in enumerate(awkward)}, library, tiers[-1])
    steps = defaultdict(set)
    for s, pieces in sequences.items():
        steps[pieces[0].tier, pieces[0].step].add(s)
    for tier in tiers:
        sizes = [len(s) for (t, _), s in steps.items() if t == tier]
        assert not sizes or max(sizes) - min(sizes) <= 1 and max(sizes) * tier <= max(step, tier)


def test_query_columns_and_sequences(docs, library):
    pieces = packing.pack(docs, PATH, END)
    crc = {(r.sequence_id, r.offset): r.crc for r in pieces.select("sequence_id", "offset", F.crc32("ids").alias("crc")).collect()}
    whole = packing.sequences(pieces).collect()
    for s in whole:
        at = 0
        for n in s.lengths:
            assert crc[s.sequence_id, at] == zlib.crc32(bytes(s.ids)[4 * at : 4 * (at + n)])
            at += n
        assert 4 * at == len(s.ids)


def _spread(counts):
    rng = random.Random(counts)
    return {rng.randrange(1, 4096): rng.randrange(1, 5 ** rng.randrange(1, 6)) for _ in range(counts)}


@pytest.mark.parametrize("counts", [{1: 1}, {3000: 1}, {3000: 1000}, {4095: 3, 1: 1}, {1: 10**6, 2049: 10**5}, {7: 12345, 4000: 10**9}, {n: 10**6 // n for n in range(1, 4096)}, *map(_spread, range(1, 40))])
def test_plans_have_no_padding_and_stay_small(counts):
    plan = packing.make_plan(counts, 5)
    groups = packing.pack_lengths(counts)
    assert all(sum(p.per * p.length for p in g.parts) == g.size and all(p.hi - p.lo == g.n * p.per for p in g.parts) for g in groups)
    tokens = defaultdict(int)
    for g in groups:
        for p in g.parts:
            tokens[p.of] += (p.hi - p.lo) * p.length
    assert tokens == {n: n * c for n, c in counts.items()}
    assert len(plan.start) <= 4000 + 40 * len(counts)  # whatever the counts


def test_steps_cost_the_same():
    counts = {n: 2000 for n in range(200, 4096, 3)}
    groups = sorted(packing.pack_lengths(counts), key=lambda g: (-g.size, -g.cost))
    plan, cost, at = packing.make_plan(counts, 0), defaultdict(int), 0
    for g in groups:
        _, step = plan.step(np.arange(at, at + g.n))
        for s, n in zip(*np.unique(step, return_counts=True), strict=True):
            cost[g.size, s] += g.cost * int(n)
        at += g.n
    of_longest = [c for (size, _), c in cost.items() if size == 4096]
    assert len(of_longest) > 100 and max(of_longest) < 1.05 * min(of_longest)


def test_words_give_the_librarys_ids(library):
    rng = random.Random(5)
    letters = "".join(map(chr, [*range(9, 14), *range(32, 127), *range(0xA0, 0x250)])) + "İΣσς'''sstrevmlldd  \n²¼東🙂"
    texts = ["".join(rng.choice(letters) for _ in range(40)) for _ in range(3000)]
    texts += ["", "it's we'LL I'm 'S 'sX '' 's'", "<|endoftext|> a <|startoftext|>", "\x00a\x1cb\x85c d", "x" * 5000, "é é"]
    assert sum(PLAIN.fullmatch(t) is not None for t in texts) > 100
    got = word_codec(PATH).encode(texts)
    assert [x.tolist() for x in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_empty_table(nothing):
    assert packing.pack(nothing, PATH, END).count() == 0
