"""The pipeline's stages against brute force on a fixture, and their effect on the small tables."""

import public_tokenizers
import tiktoken

import corpus_pipeline
from tidemark.llm import bpe, mixing

from .test_minhash import brute

SF = "/root/testdata/sf0.001"


def fixture(spark):
    english = "the house and the tree with them by the river of that land "
    german = "der baum und das haus mit ihnen an dem fluss von jenem land "
    rows = [(i, english * 3 + f"number{chr(97 + i % 26)} {chr(97 + i // 26)}", "en", f"s{i % 3}", 0) for i in range(40)]
    rows += [(100 + i, german * 3 + f"nummer{chr(97 + i % 26)}", "de", "s0", 0) for i in range(20)]
    rows += [(200, english * 20, "en", "s1", 0), (201, english * 20 + "x", "en", "s1", 0), (203, "12 %% 4", "en", "s1", 0), (204, None, None, None, None)]
    rows += [(205, "the tree and the house token = \"abc123def456\" by them", "en", None, 0), (206, "", "en", "s1", 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")


def test_stages(spark):
    docs = fixture(spark)
    stage = dict(corpus_pipeline.STAGES)
    first = stage["language_id"](spark, docs, SF)
    assert first.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in first.collect()} == {203, 204, 206}
    second = stage["minhash_dedup"](spark, first, SF)
    part = brute([(r.doc_id, r.text) for r in first.collect()], 80, 5)
    assert second.columns == docs.columns
    assert sorted(r.doc_id for r in second.collect()) == sorted({c for c in part.values()})
    third = stage["secret_scan"](spark, second, SF)
    assert third.columns == docs.columns and third.count() == second.count()
    text = {r.doc_id: r for r in third.collect()}
    assert text[205].text == 'the tree and the house token = "[REDACTED]" by them' and text[205].n_chars == len(text[205].text)
    fourth = stage["mixing"](spark, third, SF)
    want = {r.doc_id for r in mixing.mix(third, budget=corpus_pipeline.BUDGET).collect() if r.selected}
    assert fourth.columns == docs.columns and {r.doc_id for r in fourth.collect()} == want
    encoding = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, special_tokens={},
        mergeable_ranks=bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
    )
    for r in stage["byte_bpe"](spark, fourth, SF).collect():
        assert r.token_ids == encoding.encode_ordinary(text[r.doc_id].text)


def test_repeated_doc_ids_leave_one_row(spark):
    docs = fixture(spark)
    again = corpus_pipeline.drop_near_duplicates(spark, docs.unionAll(docs), SF)
    rows = again.collect()
    assert len(rows) == len({r.doc_id for r in rows})


def test_run_on_the_smallest_tables_and_on_none(spark, tmp_path):
    out = corpus_pipeline.run(spark, SF)
    assert 0 < out.count() <= 200
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
