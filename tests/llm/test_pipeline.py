import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from rillflow.llm import quality_rules
from test_decontaminate import plain as leaks
from test_near_dedup import plain as components
from test_quality_rules import measures
from test_suffix_dedup import corpus, learn_hashes
from test_suffix_dedup import plain as cuts


@pytest.fixture(scope="module")
def folder(spark, awkward, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(100 + n, t) for n, (_, t) in enumerate(corpus(6) + list(awkward))] + [(None, "a text with no id but well over ten words in it to keep"), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(1, rows[0][1][20:120]), (2, "xi omicron"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, items


def test_every_stage_on_what_the_one_before_kept(spark, folder):
    path, rows, items = folder
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    got = {}
    for name, stage in P.STAGES:
        docs = stage(spark, docs, path)
        got[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == P.COLUMNS
    want = [r for r in rows if measures(r[1])[-1]]
    assert quality_rules.BASE_RULES
    order = lambda pairs: sorted(pairs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert order((r.doc_id, r.text) for r in got["quality_rules"]) == order(want)
    kept = {c[0] for c in components(want) if c[3]}
    want = [r for r in want if r[0] in kept]
    assert order((r.doc_id, r.text) for r in got["near_dedup"]) == order(want)
    learn_hashes(spark, want)
    want = [(c[0], c[4].decode("utf-8", "ignore")) for c in cuts(want)]
    assert order((r.doc_id, r.text) for r in got["suffix_dedup"]) == order(want)
    assert all(r.n_chars == len(r.text) for r in got["suffix_dedup"])
    want = [r for r, x in zip(want, leaks(want, items), strict=True) if not x[-1]]
    assert order((r.doc_id, r.text) for r in got["decontamination"]) == order(want)
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in want}
    assert {r.doc_id: list(r.ids) for r in got["bpe"]} == ids
    assert all(r.n_tokens == len(r.ids) for r in got["bpe"])
    assert {r.doc_id: list(r.ids) for r in P.run(spark, path).collect()} == ids


def test_empty_tables(spark, folder, tmp_path):
    path = folder[0]
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
