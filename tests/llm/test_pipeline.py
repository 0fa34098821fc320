"""The pipeline's stages on the smallest tables, and the numbered queries' SQL."""

from __future__ import annotations

import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gustflow.llm import queries, sql

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages_hold_together(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_deduplication", "mixing", "packing"]
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, before, SF).persist()
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "packing":
            break
        assert after.columns == list(corpus_pipeline.COLUMNS)
        if name == "near_deduplication":
            assert len(ids) == len(set(ids))
        if name == "mixing":
            assert max(ids.count(i) for i in set(ids)) <= 2
        assert all(r["n_chars"] == len(r["text"]) for r in after.collect())
        before = after
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = {r["doc_id"]: r["text"] for r in before.collect()}
    pieces = after.filter("start = 0").collect()
    for r in pieces:
        want = t.encode(last[r["doc_id"]], add_special_tokens=False).ids + [1]
        assert np.frombuffer(r["input_ids"], "<u4").tolist() == want[: r["length"]]
    assert texts


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_numbered_queries_are_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.QUERIES[name](spark, SF)
    wanted = con.sql(sql.ORACLE_SQL[name])
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    rows = lambda got, names: sorted(tuple(str(r[names.index(c)]) for c in columns) for r in got)
    assert rows([tuple(r) for r in found.collect()], found.columns) == rows(wanted.fetchall(), wanted.columns)


def test_quality_rules_remove_a_line_of_few_documents_of_a_large_host(spark):
    texts = [("Same footer here\n" if k < 25 else "") + " ".join(f"d{k}w{j}" for j in range(60)) for k in range(400)]
    docs = spark.createDataFrame(
        [(k, t, "en", "large", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    out = {r["doc_id"]: r["text"] for r in corpus_pipeline.quality_rules(spark, docs, SF).collect()}
    assert out == {k: t.removeprefix("Same footer here\n") for k, t in enumerate(texts)}


def test_near_deduplication_links_at_eighty_percent(spark):
    words = [f"w{j}" for j in range(60)]
    near = [*words[:30], "other", *words[31:]]  # 51 of 61 shingles shared: 0.836
    far = [*words[:20], "x", *words[21:40], "y", *words[41:]]  # 46 of 66: 0.697
    rows = [(k, " ".join(w), "en", "s", len(" ".join(w))) for k, w in enumerate((words, near, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_deduplication(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 2]


def test_stages_stand_edge_cases_and_foreign_columns(spark):
    """Nulls, empty texts, ties, repeated rows, empty tables, missing and clashing columns in every stage."""
    body = " ".join(f"w{j}" for j in range(70))
    rows = [(1, body, "s"), (1, body, "s"), (2, None, "s"), (3, "", None), (None, body + " x", None), (None, None, None), (4, "y " * 300, "t")]
    rows += [(10 + k, " ".join(f"d{k}w{j}" for j in range(80)), "t") for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    own = ["score", "predicted", "kept", "_words", "_host", "_hashes", "_gone", "size", "_key", "_source", "_filler", "copies", "component_id", "_own_x", "a.b`c"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for df in (docs, docs.withColumns({c: F.lit(c) for c in own}).select("`a.b``c`", "*").drop("lang").select("*")):
            df = df.select(*dict.fromkeys("`" + c.replace("`", "``") + "`" for c in df.columns[-len(own) - 3 :]))
            got = stage(spark, df, SF)
            assert got.columns == df.columns, name
            out = got.collect()
            assert all(r[c] == c for r in out for c in df.columns if c in own), name
            if name == "near_deduplication":
                assert sum(r["doc_id"] == 1 for r in out) == 2 and sum(r["doc_id"] is None for r in out) == 2
            if name == "quality_rules":
                assert {r["doc_id"] for r in out} == {1, None, *range(10, 15)}
        assert stage(spark, docs.filter("false"), SF).count() == 0
    packed = corpus_pipeline.sequence_packing(spark, docs.withColumns({c: F.lit(c) for c in ("_ids", "_own_ids", "bucket")}), SF).collect()
    assert {r["_ids"] + r["_own_ids"] for r in packed} == {"_ids_own_ids"} and sum(r["length"] for r in packed if r["doc_id"] in (2, 3)) == 2
    assert len({r["sequence_id"] for r in packed}) == len(packed)


def test_all_thirteen_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
