"""Columns whose names are no identifiers, or are those of columns that operators make."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rillflow.llm import bpe, quality_classifier, sharding, suffix_dedup, token_counts, url_filters

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
ODD = ["a b", "a.b", "size", "kept", "ids", "a`b"]


@pytest.mark.parametrize("name", ODD)
def test_results_do_not_depend_on_the_ids_name(docs, name):
    named = docs.select(F.col("doc_id").alias(name), "text", F.lit(1).alias("row"))
    plain = docs.select("doc_id", "text")

    def same(got, want):
        assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect()))) and got.columns[0] == name

    same(token_counts.count_tokens(named, PATH, PATTERN, id_col=name), token_counts.count_tokens(plain, PATH, PATTERN))
    same(sharding.contiguous_shards(named, 5, id_col=name), sharding.contiguous_shards(plain, 5))
    if name != "ids":
        same(bpe.encode(named, PATH, PATTERN, keep=[name], segment=500), bpe.encode(plain, PATH, PATTERN, segment=500))
    model = quality_classifier.train(["good plain words", "bad *** stuff"] * 5, [1, 0] * 5)
    same(quality_classifier.score(named, model, id_col=name), quality_classifier.score(plain, model))
    urls = F.concat(F.lit("https://a.example.com/en/"), F.col("text")).alias("url")
    rules = [("com", "/en/", "block")]
    same(url_filters.filter_urls(named.select(F.col(f"`{name.replace('`', '``')}`"), urls), rules, id_col=name), url_filters.filter_urls(plain.select(F.col("doc_id").alias("page_id"), urls), rules))


def test_a_made_column_stands_for_a_kept_one_of_its_name(docs):
    got = bpe.encode(docs.withColumn("ids", F.lit("x")), PATH, PATTERN, keep=["doc_id", "ids"])
    assert got.columns == ["doc_id", "ids"] and got.count() == docs.count()


def test_string_ids_in_suffix_dedup(spark):
    passage = " ".join(f"word{i * 7919 % 1000}" for i in range(40))
    texts = [f"{passage} one", f"two {passage}", "x" * 300, f"{passage} one", None, f"zz {passage} {passage}"]
    names = ["b", "a", None, "c", "d", "é"]
    rows = spark.createDataFrame(list(zip(names, texts, strict=True)), "doc_id string, text string").repartition(3)
    order = {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is not None, n or "")))}
    numbers = spark.createDataFrame([(order[n], t) for n, t in zip(names, texts, strict=True)], "doc_id long, text string")
    want = {r.doc_id: (r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.measure_repeats(numbers).collect()}
    got = {order[r.doc_id]: (r.n_removed, r.n_spans, r.kept) for r in suffix_dedup.measure_repeats(rows).collect()}
    assert got == want and sum(n for n, _, _ in want.values()) > 500
