import re

import numpy as np
from pyspark.sql import functions as F

from rillflow.llm import quality_classifier as C


def planted(spark, n=900):
    good = "concat_ws(' ', transform(sequence(1, 40 + cast(id % 50 as int)), i -> substr(md5(cast(id * 77 + i as string)), 1, 5)))"
    return spark.range(n).selectExpr("id as doc_id", f"if(id % 3 = 0, regexp_replace({good}, ' ', '*** '), {good}) as text", "cast(id % 3 != 0 as int) as quality")


def test_learns_what_labels_mark(spark):
    rows = planted(spark)
    model = C.fit(rows.select("doc_id", "text"), rows.select("doc_id", "quality"), sample_rows=400)
    scored = C.score(rows, model).join(rows.where(C.held_out(F.col("doc_id"))), "doc_id")
    assert scored.where("predicted != quality").count() <= 0.03 * scored.count()
    assert scored.where("score < 0 or score > 1 or predicted != int(score >= 0.7)").count() == 0


def test_held_out_labels_are_not_used(spark):
    rows = planted(spark)
    flipped = rows.select("doc_id", F.when(C.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"))
    a, b = (C.fit(rows.select("doc_id", "text"), x, sample_rows=300) for x in (rows.select("doc_id", "quality"), flipped))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias


def test_awkward_texts_and_no_labels(docs, awkward, nothing, spark):
    labels = spark.createDataFrame([(0, None), (None, 1)], "doc_id long, quality int")
    model = C.fit(docs, labels)
    got = C.score(docs, model).collect()
    assert len(got) == len(awkward) and {r.score for r in got} == {0.5}
    trained = C.train(["good plain words", "bad *** stuff"] * 20, np.array([1, 0] * 20))
    assert all(0 <= r.score <= 1 for r in C.score(docs, trained).collect())
    assert C.score(nothing, trained).count() == 0
    assert C.fit(nothing, labels).bias == 0


def test_blocks_do_not_change_scores(awkward):
    import pyarrow as pa

    trained = C.train(["good plain words", "bad *** stuff"] * 20, np.array([1, 0] * 20))
    texts = pa.array([t for _, t in awkward], pa.string())
    whole = np.concatenate([trained.scores(d, at) for _, _, d, at in C.T.blocks(texts)])
    single = np.concatenate([trained.scores(d, at) for _, _, d, at in C.T.blocks(texts, 1)])
    assert np.allclose(whole, single)


def plain_features(text):
    """Buckets of one text, feature by feature."""
    data, out = (text or "").encode(), []
    words = [w for w in re.split(rb"[\x20\x09-\x0D]+", data) if w]
    hashed = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        hashed.append(int(C.T.word_hashes(raw, np.array([0]), np.array([len(raw)]))[0]))
    out += [h >> (64 - C.BITS) for h in hashed]
    for a, b in zip(hashed, hashed[1:], strict=False):
        out.append(int(C.T.mix(np.array([(a * 0xD6E8FEB86659FD93 + b) % 2**64], np.uint64))[0]) >> (64 - C.BITS))
    for n in C.GRAMS:
        for k in range(len(data) - n + 1):
            code = n
            for byte in data[k : k + n]:
                code = code * 0x01000193 % 2**32 ^ byte
            code = code * 0x9E3779B1 % 2**32
            code ^= code >> 15
            out.append((code * 0x85EBCA77 % 2**32) >> (32 - C.BITS))
    return out


def test_features_one_by_one(awkward):
    texts = [t for _, t in awkward if t is None or len(t) < 3000]
    import pyarrow as pa

    got = [[] for _ in texts]
    for lo, _, data, at in C.T.blocks(pa.array(texts, pa.string())):
        for bucket, first in C.features(data, at):
            for i, (a, z) in enumerate(zip(first[:-1], first[1:], strict=True)):
                got[lo + i] += bucket[a:z].tolist()
    assert [sorted(g) for g in got] == [sorted(plain_features(t)) for t in texts]


def test_a_step_of_training_one_by_one():
    """One pass of two steps, recomputed with a loop over texts, features and numbers."""
    texts, labels, dim, rate, seed, rows = ["good plain words", "bad *** stuff", "plain good", "", "*** !!"], [1, 0, 1, 1, 0], 3, 0.5, 5, 3
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((1 << C.BITS, dim)) - 0.5) / dim).astype(np.float32).astype(float)
    layer, bias = (rng.standard_normal((dim, 2)) / np.sqrt(dim)).astype(np.float32).astype(float), np.zeros(2)
    weight = [len(labels) / (2 * labels.count(c)) for c in (0, 1)]
    order, steps = rng.permutation(len(texts)), 2
    for step in range(steps):
        chosen, now = order[step * rows : (step + 1) * rows], rate * (1 - step / steps)
        moves, d_layer, d_bias = {}, np.zeros((dim, 2)), np.zeros(2)
        for i in chosen:
            found = plain_features(texts[i])
            share = {b: found.count(b) / len(found) for b in set(found)}
            mean = sum((s * vectors[b] for b, s in share.items()), np.zeros(dim))
            p = np.exp(mean @ layer + bias)
            p /= p.sum()
            error = (p - np.eye(2)[labels[i]]) * weight[labels[i]] / len(chosen)
            d_layer += np.outer(mean, error)
            d_bias += error
            size = now * len(chosen) / max(sum(s * s for s in share.values()), 1e-6)
            for b, s in share.items():
                moves[b] = moves.get(b, np.zeros(dim)) + s * size * (layer @ error)
        layer, bias = layer - now * d_layer, bias - now * d_bias
        for b, m in moves.items():
            vectors[b] -= m
    got = C.train(texts, np.array(labels), dim=dim, epochs=1, rate=rate, seed=seed, rows=rows)
    assert np.allclose(got.weight, vectors @ (layer[:, 1] - layer[:, 0]), atol=1e-4) and np.isclose(got.bias, bias[1] - bias[0], atol=1e-5)


def test_repeated_ids_give_the_same_model_however_rows_lie(spark):
    rows = spark.createDataFrame([(i % 7, f"text {i} " + "*" * (i % 3)) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)], "doc_id long, quality int")
    a, b = (C.fit(x, labels, sample_rows=20) for x in (rows.repartition(5), rows.orderBy(F.desc("text")).coalesce(1)))
    assert np.array_equal(a.weight, b.weight) and a.bias == b.bias
