"""Audits of identity data: duplicate keys, licence shapes, status vocabularies, and blinded clerical review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rosterloom.functions.agreement import license_anatomy, normalize_license_status
from rosterloom.functions.vocab import LICENSE_STATUS_LEVELS


def duplicate_differences(df: DataFrame, key: str | list[str], ignore: list[str] | None = None) -> DataFrame:
    """For each key on several rows, the columns whose values differ.

    key columns, column, n_rows, n_values, values (sorted, " | " between), has_absence, absence_only; one row named
    <identical> where nothing differs. Absent keys group nothing.
    """
    keys = [key] if isinstance(key, str) else list(key)
    if missing := [c for c in (*keys, *(ignore or [])) if c not in df.columns]:
        raise ValueError(f"df is missing: {', '.join(missing)}")
    cols = [c for c in df.columns if c not in keys and c not in (ignore or [])]
    whole = df.dropna(subset=keys)
    groups = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), *[F.collect_set(c).alias(f"s{i}") for i, c in enumerate(cols)], *[F.max(F.col(c).isNull()).alias(f"a{i}") for i, c in enumerate(cols)])
    groups = groups.filter("n_rows > 1")

    def entry(i: int, c: str) -> Column:
        n, gone = F.size(f"s{i}"), F.col(f"a{i}")
        values = F.array_join(F.transform(F.array_sort(F.col(f"s{i}")), lambda v: v.cast("string")), " | ")
        found = F.struct(F.lit(c).alias("column"), n.alias("n_values"), values.alias("values"), gone.alias("has_absence"), (n <= 1).alias("absence_only"))
        return F.when(n + gone.cast("int") > 1, found)

    same = F.struct(F.lit("<identical>").alias("column"), F.lit(0).alias("n_values"), F.lit("").alias("values"), F.lit(False).alias("has_absence"), F.lit(False).alias("absence_only"))
    rows = F.filter(F.array(*[entry(i, c) for i, c in enumerate(cols)]), lambda e: e.isNotNull()) if cols else F.array().cast("array<struct<column:string,n_values:int,values:string,has_absence:boolean,absence_only:boolean>>")
    found = groups.select(*keys, "n_rows", F.explode(F.when(F.size(rows) > 0, rows).otherwise(F.array(same))).alias("d"))
    return found.select(*keys, "d.column", "n_rows", "d.n_values", "d.values", "d.has_absence", "d.absence_only")


def license_conformance(df: DataFrame, license: str, state: str, min_share: float = 0.01) -> DataFrame:
    """``df`` with the licence's anatomy, its shape's share within the state, the modal shape and whether it stands out."""
    st = F.nullif(F.upper(F.trim(F.col(state).cast("string"))), F.lit(""))
    out = df.withColumn("__a", license_anatomy(license)).withColumn("__state", st)
    usable = F.col("__a.key").isNotNull() & F.col("__state").isNotNull()
    # shapes per state are counted first, so the window sees a row for each shape
    shapes = out.filter(usable).groupBy("__state", F.col("__a.shape").alias("__shape")).agg(F.count(F.lit(1)).alias("__n"))
    of_state = W.partitionBy("__state")
    shapes = shapes.withColumns({
        "shape_share": F.col("__n") / F.sum("__n").over(of_state),
        "state_modal_shape": F.min(F.struct((-F.col("__n")).alias("n"), "__shape")).over(of_state)["__shape"],
    }).select(F.col("__state").alias("__s"), F.col("__shape").alias("__sh"), "shape_share", "state_modal_shape")
    joined = out.join(shapes, (F.col("__state") == F.col("__s")) & (F.col("__a.shape") == F.col("__sh")), "left")
    flagged = F.when(usable, (F.col("__a.shape") != F.col("state_modal_shape")) & (F.col("shape_share") < min_share))
    own = [c for c in df.columns if c not in (license, state)]
    return joined.select(*own, "__a.*", F.col("__state").alias("state"), "shape_share", "state_modal_shape", flagged.alias("flagged"))


def license_status_audit(df: DataFrame, status: str, source: str, levels: dict[str, list[str]] = LICENSE_STATUS_LEVELS) -> DataFrame:
    """source, status_raw, class, n, mapped; unmapped and frequent first within a source."""
    cls = normalize_license_status(status, levels)
    out = df.groupBy(F.col(source).cast("string").alias("source"), F.coalesce(F.col(status).cast("string"), F.lit("<NA>")).alias("status_raw"), cls.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("mapped", F.col("class").isNotNull()).orderBy("source", "mapped", F.desc("n"), "status_raw")


def clerical_sample(per_candidate: DataFrame, n_per_class: int, seed: int, id: str = "id", candidate: str = "candidate", cls: str = "evidence_class", cols: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """A blinded review sheet (the class isn't shown) and its key: at most ``n_per_class`` pairs of each class, in seeded order."""
    if seed is None:
        raise ValueError("seed is required: the draw must be reproducible")
    if missing := [c for c in (id, candidate, cls) if c not in per_candidate.columns]:
        raise ValueError(f"per_candidate is missing: {', '.join(missing)}")
    shown = [c for c in (cols if cols is not None else per_candidate.columns) if c != cls]
    if bad := [c for c in shown if c not in per_candidate.columns]:
        raise ValueError(f"cols not in per_candidate: {', '.join(bad)}")
    draw = lambda k: F.sha2(F.concat_ws("\r", F.lit(f"{seed}/{k}"), F.col(id).cast("string"), F.col(candidate).cast("string")), 256)
    within = W.partitionBy(cls).orderBy(draw("take"), id, candidate)
    taken = per_candidate.withColumn("__n", F.row_number().over(within)).filter(F.col("__n") <= n_per_class).drop("__n")
    ids = taken.withColumn("review_id", F.format_string("REV%04d", F.row_number().over(W.orderBy(draw("order"), id, candidate))))  # the sample is small
    sheet = ids.select("review_id", *shown).withColumn("reviewer_verdict", F.lit(None).cast("string"))
    return sheet, ids.select("review_id", id, candidate, cls)


def clopper_pearson(k: int, n: int, level: float = 0.95) -> tuple[float, float]:
    """Exact confidence limits of a proportion, by halving on the binomial tail."""

    def tail(p: float, low: int, high: int) -> float:
        if p <= 0 or p >= 1:
            return float(low <= (0 if p <= 0 else n) <= high)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(low, high + 1)]
        return math.fsum(math.exp(v) for v in logs)

    def solve(f, target: float, rising: bool) -> float:
        lo, hi = 0.0, 1.0
        for _ in range(100):
            mid = (lo + hi) / 2
            if (f(mid) < target) == rising:
                lo = mid
            else:
                hi = mid
        return (lo + hi) / 2

    a = (1 - level) / 2
    low = 0.0 if k == 0 else solve(lambda p: tail(p, k, n), a, True)
    high = 1.0 if k == n else solve(lambda p: tail(p, 0, k), a, False)
    return low, high


def clerical_counts(key: DataFrame, verdicts: DataFrame, cls: str = "evidence_class") -> DataFrame:
    """Per class: n_sampled, n_reviewed, n_match, precision."""
    joined = key.join(verdicts.select("review_id", "is_match"), "review_id", "left")
    n, m = F.count("is_match"), F.count_if(F.col("is_match"))
    return joined.groupBy(cls).agg(F.count(F.lit(1)).alias("n_sampled"), n.alias("n_reviewed"), m.alias("n_match"), F.when(n > 0, m / n).alias("precision"))


def clerical_precision(key: DataFrame, verdicts: DataFrame, cls: str = "evidence_class", level: float = 0.95) -> DataFrame:
    """clerical_counts with exact limits ci_low and ci_high; null where nothing was reviewed. One row for each class."""
    if missing := [c for c in ("review_id", "is_match") if c not in verdicts.columns]:
        raise ValueError(f"verdicts needs columns {', '.join(missing)}")
    if unknown := [r[0] for r in verdicts.select("review_id").distinct().join(key, "review_id", "left_anti").limit(5).collect()]:
        raise ValueError(f"verdicts carry unknown review ids: {', '.join(unknown)}")
    if not verdicts.groupBy("review_id").count().filter("count > 1").isEmpty():
        raise ValueError("verdicts holds more than one row for a review id")
    counts = clerical_counts(key, verdicts, cls)
    rows = [(*r, *(clopper_pearson(r["n_match"], r["n_reviewed"], level) if r["n_reviewed"] else (None, None))) for r in counts.orderBy(cls).collect()]
    schema = counts.schema.add("ci_low", "double").add("ci_high", "double")
    return counts.sparkSession.createDataFrame(rows, schema)


def shared_keys(df: DataFrame, id: str, on: list[str], broadcast_bytes: int = 64 << 20) -> DataFrame:
    """id_a, id_b and the columns ``on``: ordered pairs of rows with other ids that share all of ``on``; a null shares nothing.

    Known negatives of a matcher, as people of one household are. The result has n * (n - 1) rows for n rows of one key, so
    ``on`` has to be selective: it is a join on the columns, never on one of them alone.
    """
    if missing := [c for c in (id, *on) if c not in df.columns]:
        raise ValueError(f"df is missing: {', '.join(missing)}")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # each row meets the others of its key in lists of some 1024, so a frequent key is spread over tasks and no pair is shuffled
    known = df.select(id, *on).dropna(subset=on)
    lists = F.ceil(F.count(F.lit(1)).over(W.partitionBy(*on)) / 1024)
    others = known.withColumn("__part", F.pmod(F.xxhash64(id), lists)).groupBy(*on, "__part").agg(F.collect_list(id).alias("__others")).drop("__part")
    if known.count() * 48 <= broadcast_bytes:
        others = F.broadcast(others)
    met = known.withColumnRenamed(id, "id_a").repartition(tasks, "id_a").join(others, on)
    return met.select("id_a", F.explode("__others").alias("id_b"), *on).filter("id_a <> id_b")
