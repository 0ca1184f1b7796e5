import hashlib

import pytest
from helpers import documents
from pyspark.sql import functions as F

from rosterloom.llm import exact_dedup as ed

TEXTS = ["a", "b", "a", "", None, "a ", "b", "x" * 200_000, "x" * 200_000, "c"]


def brute(rows, best):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return sorted((i, best(groups[t or ""]), len(groups[t or ""]), i == best(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


@pytest.mark.parametrize("keep,best", [("smallest", min), ("largest", max)])
@pytest.mark.parametrize("content_hash", [ed.md5_128, lambda t: F.length(t).cast("string").cast("binary")])
def test_groups(spark, keep, best, content_hash):
    """The second hash collides for all texts of one length: bytes decide."""
    docs = documents(spark, TEXTS, ids=[9, 4, 2, 7, 1, 3, 6, 8, 5, 0], extra=("keep_id string, h int, kept boolean", ("z", 1, False)))
    got = ed.exact_groups(docs, keep=keep, content_hash=content_hash)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect())) == brute([(r["doc_id"], r["text"]) for r in docs.collect()], best)


def test_columns_of_any_name_stay(spark):
    docs = documents(spark, ["a", "a", "b", "b"], ids=[1, 2, 3, 3], extra=("id int, hash string, `row` string, keep_id string, group_size string, n_kept string, __row string", (5, "h", "r", "k", "g", "n", "mine")))
    kept = ed.exact_dedup(docs, keep="largest")
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a", "en", "src0", 1, 5, "h", "r", "k", "g", "n", "mine"), (3, "b", "en", "src0", 1, 5, "h", "r", "k", "g", "n", "mine")]


def test_texts_move_only_for_groups(spark):
    """Hashes alone are grouped; the whole texts are in no exchange but that of the comparison."""
    docs = documents(spark, TEXTS)
    plan = ed.exact_groups(docs)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange") == plan.count("BroadcastExchange")


@pytest.mark.parametrize("limit", [10**6, 0])
def test_dedup_rows(spark, limit):
    docs = documents(spark, ["a", "a", "b", "b", None, "", "q", "other"], ids=[1, 2, 3, 3, 5, None, 7, 7])
    kept = ed.exact_dedup(docs, keep="largest", broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"] or "") for r in kept.collect()) == [(2, "a"), (3, "b"), (5, ""), (7, "other"), (7, "q")]


def test_no_rows(spark):
    assert ed.exact_groups(documents(spark, ["a"]).limit(0)).collect() == []
    assert ed.exact_dedup(documents(spark, ["a"]).limit(0)).collect() == []
