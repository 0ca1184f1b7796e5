"""Mixing sources to target weights by stratified Pareto order sampling.

Each source gets a word target: its weight's share of the whole, at most ``max_repeats`` times its own words, with what
is above that limit shared out again by weight (a water level, found by one window over the table of sources).

Within a source a document is expected to come min(``max_repeats``, rate x weight) times. A document's weight is the bit
length of its word count (1 for one word, 11 for a thousand), so longer documents come somewhat more often, or a column;
the rate is the one at which the expected words meet the target, found from the words that each weight has in a source.
The whole part of that number is taken for certain. For the fraction p documents are ranked by [u/(1-u)] / [p/(1-p)], u a
hash of id and text, and taken in that order until the words that the whole copies leave are reached, to the nearest
document: an unequal-probability sample of a fixed size in words.

The cut in that order is found without sorting a source in one task: two rounds of a 4096-bin histogram over the rank
narrow it to one cell with about a 16-millionth of the source's documents, and only that cell is ordered exactly, with a
row for all documents of one rank. The tables of sources and of cuts are broadcast only after their rows were counted.

Defined results: null or empty texts have size 0 and are never drawn; a null source is a source of its own, last in order;
rows with one id, source and text share their rank and are taken alike, rows with one id and different texts are drawn
each; a weight that is null, or not above 0, counts as the least one; an empty table gives an empty result; extra columns,
of whatever name, are ignored, and kept by ``apply_mix``. Reruns agree: u depends on id, text and seed only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.llm import common

BINS = 4096
WEIGHTS = (5, 2, 1)
#: The least weight of a document; weights of a column are rounded to three significant digits from here on.
LEAST_WEIGHT = 1e-6


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(common.words_pattern())).cast("long")


def uniform(doc_id: Column, text: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 from 52 bits of an MD5 of seed, id and the text's MD5."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def bit_length(size: Column) -> Column:
    """Binary digits of a word count, as a weight."""
    return F.length(F.bin(size)).cast("double")


def _three_digits(weight: Column) -> Column:
    """Three significant digits, so a source has at most 900 weights for each power of ten."""
    known = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(LEAST_WEIGHT))
    unit = F.pow(F.lit(10.0), F.floor(F.log10(known)) - 2)
    return F.round(known / unit) * unit


def source_targets(per_source: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """source, source_size -> adds target. One row per source goes in and out; the windows see that table alone."""
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    listed = per_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    listed = listed.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats)))
    order = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    all_rows = W.partitionBy()
    before, after = order.rowsBetween(W.unboundedPreceding, -1), order.rowsBetween(0, W.unboundedFollowing)
    level = (F.sum("source_size").over(all_rows) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        listed.withColumn("level", level)
        .withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), "source", "level"))).over(all_rows)["level"])
        .select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))
    )


def _expected(max_repeats: int) -> Column:
    """Copies that a document is expected to have; whole copies are its floor."""
    return F.when(F.col("size") > 0, F.least(F.lit(float(max_repeats)), F.coalesce("rate", F.lit(float(max_repeats))) * F.col("w"))).otherwise(F.lit(0.0))


def source_rates(per_weight: DataFrame, targets: DataFrame, max_repeats: int) -> DataFrame:
    """source, w, size -> source, source_size, target, rate and rest, the words that whole copies leave of the target.

    Weights that reach ``max_repeats`` copies are the largest ones; the rate is null where all do. ``per_weight`` has a row
    for each source and weight, some thousands for a source at most.
    """
    of_source = targets.withColumnRenamed("source", "of_source")
    rows = per_weight.join(of_source, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    down = W.partitionBy("source").orderBy(F.col("w").desc())
    before, after = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(0, W.unboundedFollowing)
    rate = (F.col("target") - F.lit(float(max_repeats)) * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum(F.col("w") * F.col("size")).over(after)
    rows = rows.withColumn("own_rate", F.when(F.col("size") > 0, rate))
    # the first weight, from above, that stays below the limit
    rows = rows.withColumn("rate", F.max(F.when(F.col("own_rate") * F.col("w") < max_repeats, F.struct("w", "own_rate"))).over(W.partitionBy("source"))["own_rate"])
    copies = _expected(max_repeats)
    rest = F.sum((copies - F.floor(copies)) * F.col("size"))
    out = rows.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("rate").alias("rate"), rest.alias("rest"))
    return out


def _with(rows: DataFrame, table: DataFrame, small: bool) -> DataFrame:
    """``rows`` with the columns of ``table``, which has a row for each source or for some."""
    table = table.withColumnRenamed("source", "of_source")
    return rows.join(F.broadcast(table) if small else table, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")


def _ranked(rows: DataFrame, max_repeats: int) -> DataFrame:
    """rank = q/(1+q) of the Pareto ranking variable q, in (0, 1); b1, b2 its first and second 4096-bin digits; null for p = 0."""
    rows = rows.withColumn("whole", F.floor(_expected(max_repeats)))
    p = _expected(max_repeats) - F.col("whole")
    q = (F.col("u") / (1 - F.col("u"))) / (p / (1 - p))
    rows = rows.withColumn("rank", F.when(p > 0, q / (1 + q)))
    scaled = F.col("rank") * BINS
    return rows.withColumn("b1", F.floor(scaled)).withColumn("b2", F.floor((scaled - F.floor(scaled)) * BINS))


def _cuts(sizes: DataFrame, weights: tuple[int, ...], share: float, max_repeats: int, broadcast_limit: int) -> tuple[DataFrame, bool]:
    """A kept table with what decides each source's copies, and whether it is small enough for a broadcast.

    sizes: source, tie, size, w, u of each document.
    """
    scratch = common.Scratch()
    per_weight = scratch.keep(sizes.groupBy("source", "w").agg(F.sum("size").alias("size")), "mix-weights")
    targets = source_targets(per_weight.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_repeats)
    stats = scratch.keep(source_rates(per_weight, targets, max_repeats), "mix-sources")
    small = stats.count() <= broadcast_limit
    ranked = _ranked(_with(sizes, stats, small), max_repeats).filter("rank IS NOT NULL")
    by_source = W.partitionBy("source")

    def cell(rows: DataFrame, bins: list[str]) -> DataFrame:
        """Per source the last cell that starts before the cut, with the words before it."""
        *outer, inner = bins
        summed = rows.groupBy("source", "rest", *bins, *(["start"] if outer else [])).agg(F.sum("size").alias("words"))
        first = F.col("start") if outer else F.lit(0)
        running = first + F.coalesce(F.sum("words").over(by_source.orderBy(inner).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return summed.withColumn("start_here", running).filter("start_here < rest").groupBy("source").agg(F.max_by(F.struct(*bins, "start_here"), inner).alias("c")).select("source", *[F.col(f"c.{b}") for b in bins], F.col("c.start_here").alias("start"))

    coarse = scratch.keep(cell(ranked, ["b1"]), "mix-cells")
    inside = _with(ranked, coarse.withColumnRenamed("b1", "at1"), small).filter("b1 = at1")
    fine = scratch.keep(cell(inside, ["b1", "b2"]), "mix-cells")
    last = _with(ranked, fine.withColumnsRenamed({"b1": "at1", "b2": "at2"}), small).filter("b1 = at1 and b2 = at2")
    last = last.groupBy("source", "start", "rest", "rank", "tie").agg(F.sum("size").alias("words"))
    running = F.col("start") + F.coalesce(F.sum("words").over(by_source.orderBy("rank", "tie").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("before", running).filter("before + words * 0.5D <= rest").groupBy("source").agg(F.max(F.struct("rank", "tie")).alias("cut"))
    edges = fine.join(cut.withColumnRenamed("source", "cut_source"), F.col("source").eqNullSafe(F.col("cut_source")), "left")
    edges = edges.select(F.col("source").alias("edge_source"), F.col("b1").alias("at1"), F.col("b2").alias("at2"), "cut")
    out = common.keep(stats.join(edges, F.col("source").eqNullSafe(F.col("edge_source")), "left").drop("edge_source"), "mix-cuts")
    scratch.clear()
    return out, small


def _taken(rows: DataFrame, cuts: DataFrame, small: bool, max_repeats: int) -> DataFrame:
    """``rows`` (with source, tie, size, w, u) with source_size, target and copies."""
    done = _ranked(_with(rows, cuts, small), max_repeats)
    before = (F.col("b1") < F.col("at1")) | ((F.col("b1") == F.col("at1")) & (F.col("b2") < F.col("at2")))
    at_cut = (F.col("b1") == F.col("at1")) & (F.col("b2") == F.col("at2")) & (F.struct("rank", "tie") <= F.col("cut"))
    return done.withColumn("copies", F.col("whole") + F.coalesce((F.col("rest") > 0) & (before | at_cut), F.lit(False)).cast("long"))


def _sizes(docs: DataFrame, seed: int, weight_col: str | None, *more: Column) -> DataFrame:
    text = F.col("text")
    size = word_count(text)
    tie = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit(""))))
    picked = docs.select("doc_id", "source", size.alias("n_words"), uniform(F.col("doc_id"), text, seed).alias("u"), tie.alias("tie"), *([F.col(weight_col).alias("given")] if weight_col else []), *more)
    w = _three_digits(F.col("given")) if weight_col else bit_length(F.col("size"))
    return picked.withColumnRenamed("n_words", "size").withColumn("w", w).drop("given")


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3, seed: int = 17, weight_col: str | None = None, broadcast_limit: int = 100_000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    weight_col: optional column of positive weights, to which expected copies within a source are proportional.
    """
    sizes = common.keep(_sizes(docs, seed, weight_col), "mix-sizes")
    cuts, small = _cuts(sizes, weights, share, max_repeats, broadcast_limit)
    return _taken(sizes, cuts, small, max_repeats).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def apply_mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = 1.0, max_repeats: int = 3, seed: int = 17, weight_col: str | None = None, broadcast_limit: int = 100_000) -> DataFrame:
    """``docs`` as the mix takes them: documents with no copy go, those with several are repeated.

    Copies are decided row by row from the table of cuts, so no table of ids is joined back.
    """
    sizes = common.keep(_sizes(docs, seed, weight_col).select("source", "tie", "size", "w", "u"), "mix-sizes")
    cuts, small = _cuts(sizes, weights, share, max_repeats, broadcast_limit)
    common.drop(sizes)
    rows = _sizes(docs, seed, weight_col, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    taken = _taken(rows, cuts, small, max_repeats).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


OP4_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), weighed AS (
  SELECT *, length(bin(size))::DOUBLE AS w, (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '') || ':' || digest), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM sizes
), src AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sizes GROUP BY source
), listed AS (
  SELECT *, list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT) AS weight, source_size * 3.0::DOUBLE AS cap FROM src
), levels AS (
  SELECT *, (sum(source_size) OVER () * 1.0::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM listed
), chosen AS (
  SELECT level FROM levels WHERE level * weight <= cap ORDER BY cap / weight, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM chosen) * weight, cap)) AS target FROM levels
), classes AS (
  SELECT source, w, sum(size)::BIGINT AS words FROM weighed GROUP BY source, w
), rates AS (
  SELECT c.*, source_size, target, CASE WHEN words > 0 THEN (target - 3.0::DOUBLE * coalesce(sum(words) OVER (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
         / (sum(w * words) OVER (PARTITION BY c.source ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS own_rate
  FROM classes c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
), rated AS (
  SELECT *, CASE WHEN words > 0 THEN least(3.0::DOUBLE, coalesce(max_by(own_rate, w) FILTER (own_rate * w < 3) OVER (PARTITION BY source), 3.0::DOUBLE) * w) ELSE 0.0::DOUBLE END AS expected FROM rates
), per AS (
  SELECT source, sum((expected - floor(expected)) * words) AS rest FROM rated GROUP BY source
), joined AS (
  SELECT s.*, source_size, target, rest, CASE WHEN size > 0 THEN expected ELSE 0.0::DOUBLE END AS expected
  FROM weighed s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source AND s.w = r.w JOIN per p ON s.source IS NOT DISTINCT FROM p.source
), parts AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS p FROM joined
), ranked AS (
  SELECT *, (u / (1 - u)) / (p / (1 - p)) AS q FROM parts
), cum AS (
  SELECT *, CASE WHEN p > 0 THEN coalesce(sum(size) FILTER (p > 0) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN 0 ELSE 1 END, q / (1 + q), coalesce(doc_id::VARCHAR, '') || ':' || digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS before FROM ranked
)
SELECT doc_id, size, source_size, target, ((whole + (rest > 0 AND coalesce(before + size * 0.5::DOUBLE <= rest, false))::BIGINT) * size)::BIGINT AS taken,
       (whole + (rest > 0 AND coalesce(before + size * 0.5::DOUBLE <= rest, false))::BIGINT)::BIGINT AS copies, source FROM cum
"""
