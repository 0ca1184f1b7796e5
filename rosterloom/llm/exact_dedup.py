"""Exact deduplication by 128-bit content hash, with a comparison of bytes inside each hash group.

Only slim rows (id, 16-byte MD5 of the text) are grouped: by hash and id first, then by hash, each with a map-side part, so
a text that a third of all rows share shrinks before each shuffle. The hashes that several rows have, with the id that
stays and the group's size, are the table of groups. Texts move only for the comparison of bytes: rows whose hash is in
that table are grouped by hash *and text*, again with a map-side part, and a hash that turns out to cover several texts is
taken out of the table and goes a second path, on which the text itself is the key.

The table of groups meets the rows in a left join on the hash: as a broadcast if its bytes were counted and fit, else by a
shuffle in which adaptive execution can split a hot hash, for the rows are on the left side.

Defined results: a null text counts as empty; equal ids (repeated rows) get the same verdict; a null id never wins over
an id; an empty table gives an empty result; other columns, of whatever name, are ignored, and kept by ``exact_dedup``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterloom.llm import common


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text))


def _best(id: Column, keep: str) -> Column:
    """A struct whose maximum holds the id that stays; null ids come last."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    return F.struct(id.isNotNull().alias("known"), (id if keep == "largest" else F.bitwise_not(id)).alias("order"), id.alias("id"))


def _groups(slim: DataFrame, keep: str, key: list[str]) -> DataFrame:
    """Of slim rows (key, id): key, keep_id, group_size and the number of rows that have keep_id."""
    per_id = slim.groupBy(*key, "id").agg(F.count(F.lit(1)).alias("n"))
    best = F.struct(_best(F.col("id"), keep).alias("b"), F.col("n"))
    out = per_id.groupBy(*key).agg(F.max(best).alias("best"), F.sum("n").alias("group_size"))
    return out.filter("group_size > 1").select(*key, F.col("best.b.id").alias("keep_id"), "group_size", F.col("best.n").alias("n_kept"))


def _judged(rows: DataFrame, keep: str, broadcast_bytes: int) -> tuple[DataFrame, bool]:
    """rows (id, hash, text and others) with keep_id, group_size and n_kept, null for a text that no other row has.

    The second value tells whether any group may have several rows with its keep_id.
    """
    scratch = common.Scratch()
    groups = scratch.keep(_groups(rows.select("hash", "id"), keep, ["hash"]), "exact-groups")
    small = common.hinted(groups.select("hash"), 16, broadcast_bytes)
    texts = rows.select("hash", "text").join(small, "hash", "left_semi").groupBy("hash", "text").agg(F.lit(1).alias("one"))
    collided = scratch.keep(texts.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("hash"), "exact-collisions")
    if collided.isEmpty():
        return rows.join(common.hinted(groups, 40, broadcast_bytes), "hash", "left"), not groups.filter("n_kept > 1").isEmpty()
    clean = rows.join(collided, "hash", "left_anti").join(groups, "hash", "left")
    mixed = rows.join(collided, "hash", "left_semi")
    return clean.unionByName(mixed.join(_groups(mixed.select("hash", "text", "id"), keep, ["hash", "text"]), ["hash", "text"], "left").select(clean.columns)), True


def exact_groups(docs: DataFrame, *, keep: str = "smallest", content_hash: Callable[[Column], Column] = md5_128, broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep: "smallest" or "largest" id of each group of equal texts stays.
    content_hash: replaced in tests to force collisions.
    """
    rows = docs.select(F.col("doc_id").alias("id"), common.text_or_empty().alias("text")).withColumn("hash", content_hash(F.col("text")))
    found, _ = _judged(rows, keep, broadcast_bytes)
    best = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias("doc_id"), best.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.col("id").eqNullSafe(best).alias("kept"), F.sha2("text", 256).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, *, keep: str = "smallest", broadcast_bytes: int = common.BROADCAST_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of repeated rows with one id and text, one stays."""
    text = common.text_or_empty()
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"), md5_128(text).alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found, repeated = _judged(rows, keep, broadcast_bytes)
    stays = found.filter("group_size IS NULL OR id <=> keep_id")
    if not repeated:
        return stays.select("row.*")
    once = stays.filter("n_kept > 1").groupBy("hash", "text").agg(F.min(F.struct(F.to_json("row").alias("as_text"), "row")).alias("one"))
    return stays.filter("n_kept IS NULL OR n_kept = 1").select("row.*").unionByName(once.select("one.row.*"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(common.read(spark, sf_dir, "documents"), keep="largest")


OP8_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
