import zlib
from collections import Counter

from rillflow.llm.sharding import contiguous_shards


def test_against_a_plain_walk(docs, awkward):
    n = 5
    got = contiguous_shards(docs, n).collect()
    rows = sorted(((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in awkward), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    total, at, slots, want = sum(r[2] for r in rows), 0, Counter(), []
    for i, crc, size in rows:
        shard = (2 * at + size) * n // (2 * total)
        want.append((i, crc, size, shard, slots[shard]))
        slots[shard] += 1
        at += size
    assert Counter((r.doc_id, r.text_crc32, r.size, r.shard, r.slot) for r in got) == Counter(want)


def test_shards_are_even_and_gapless(spark):
    rows = spark.range(5000).selectExpr("id as doc_id", "repeat('é', cast(id % 90 as int)) as text")
    got = contiguous_shards(rows, 24).collect()
    sizes, slots = Counter(), {}
    for r in got:
        sizes[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 2 * 188
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_empty_table(nothing):
    assert contiguous_shards(nothing, 24).count() == 0
