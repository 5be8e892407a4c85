"""Searches of many queries over many documents: what they move grows with the two, not with their pairs."""

import pytest
from test_operators import _shuffled

import __spark_entry__ as entry

DOCS, QUERIES = 2000, 200
NAMES = ["bm25_topk", "hybrid_search", "reranked_search", "context_blocks", "model_rerank"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    # every query shares a word with every document
    spark.range(DOCS).selectExpr("id as doc_id", "concat('the fox ', id % 50) as text", "'note' as source_type").write.parquet(f"{d}/documents.parquet")
    spark.range(1, QUERIES + 1).selectExpr("id * 100 as id", "concat('the fox ', id % 50, ' of ', id) as question").write.parquet(f"{d}/conversation_turns.parquet")
    return d


@pytest.mark.parametrize("name", NAMES)
def test_moves_no_pairs(spark, tables, name):
    out = []
    moved = _shuffled(spark, lambda: out.extend(entry.queries()[name](spark, tables).collect()))
    assert len({r["query_id"] for r in out}) == QUERIES
    assert moved < DOCS * QUERIES // 4
