"""Resolution of candidates by ordered evidence; ties and contested candidates abstain.

Everything is a window or an aggregate over plain columns: the order of rows never decides.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RESOLVED, TIED, CONTESTED, NO_CANDIDATE, YIELDED = "resolved", "ambiguous_tied_evidence", "ambiguous_contested_candidate", "no_candidate", "yielded_to_eligible"

#: Levels of a facet that are read from the data at most.
MAX_LEVELS = 1000


def _require(df: DataFrame, columns: list[str], label: str) -> None:
    if missing := [c for c in dict.fromkeys(columns) if c not in df.columns]:
        raise ValueError(f"{label} is missing: {', '.join(missing)}")


def _all_columns(df: DataFrame, but: list[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in df.columns if c not in but]


def collapse_candidates(candidates: DataFrame, id: str = "id", candidate: str = "candidate", cls: str = "evidence_class", tiebreak: list[str] | None = None) -> DataFrame:
    """One row for each (id, candidate): that with the strongest (smallest) class, then by the tiebreak columns."""
    tiebreak = tiebreak or []
    _require(candidates, [id, candidate, cls, *tiebreak], "candidates")
    order = W.partitionBy(id, candidate).orderBy(*[F.col(c).asc_nulls_last() for c in (cls, *tiebreak)], *_all_columns(candidates, [id, candidate, cls, *tiebreak]))
    return candidates.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n").withColumn(cls, F.col(cls).cast("int"))


def pool_stats(per_candidate: DataFrame, id: str = "id", cls: str = "evidence_class", facet: str | None = None, levels: list[str] | None = None) -> DataFrame:
    """Per id: n_candidates, best_class, n_at_best, and n_<level> for each level of a facet.

    The rows at the best class are counted in one pass: rows per (id, class) first, then the smallest class of each id.
    Without ``levels`` they are read from the facet; more than MAX_LEVELS of them are an error, for each is a column.
    """
    per_class = per_candidate.groupBy(id, cls).agg(F.count(F.lit(1)).alias("__n"))
    best = F.min(F.struct(F.col(cls), F.col("__n")))
    out = per_class.groupBy(id).agg(F.sum("__n").cast("int").alias("n_candidates"), best[cls].cast("int").alias("best_class"), best["__n"].cast("int").alias("n_at_best"))
    if facet is None:
        return out
    if levels is None:
        levels = [r[0] for r in per_candidate.select(facet).filter(F.col(facet).isNotNull()).distinct().orderBy(facet).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{facet} has more than {MAX_LEVELS} levels; pass levels, or count them by {id} and {facet}")
    counts = per_candidate.groupBy(id).agg(*[F.count_if(F.col(facet) == F.lit(v)).cast("int").alias(f"n_{v}") for v in levels])
    return out.join(counts, id)


def resolve_best_class(per_candidate: DataFrame, stats: DataFrame, id: str = "id", cls: str = "evidence_class", confidence: list[str] | None = None, validate: bool = True) -> DataFrame:
    """The candidate that is alone at its id's best class; confidence labels are indexed by class."""
    if validate and not stats.groupBy(id).count().filter("count > 1").isEmpty():
        raise ValueError(f"stats must hold one row per {id}")
    out = per_candidate.join(stats.select(id, "best_class", "n_at_best"), id).filter((F.col(cls) == F.col("best_class")) & (F.col("n_at_best") == 1))
    if confidence is not None:
        out = out.withColumn("confidence", F.try_element_at(F.array(*map(F.lit, confidence)), F.col(cls)))
    return out


@dataclass
class OrderedClasses:
    per_candidate: DataFrame
    stats: DataFrame
    resolved: DataFrame
    quarantined: DataFrame  # ids


def resolve_ordered_classes(candidates: DataFrame, id: str = "id", candidate: str = "candidate", cls: str = "evidence_class", tiebreak=None, facet=None, confidence=None) -> OrderedClasses:
    per = collapse_candidates(candidates, id, candidate, cls, tiebreak)
    stats = pool_stats(per, id, cls, facet)
    resolved = resolve_best_class(per, stats, id, cls, confidence, validate=False)
    return OrderedClasses(per, stats, resolved, candidates.select(id).distinct().join(resolved.select(id), id, "left_anti"))


def _ranking(rank_by: dict[str, str]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in rank_by.items()]


def _present(candidates: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.isNotNull() & (F.trim(c) != "") if dict(candidates.dtypes)[column] == "string" else c.isNotNull()


def _validate(candidates: DataFrame, id: str, candidate: str, rank_by: dict[str, str]) -> None:
    if not isinstance(rank_by, dict) or not rank_by:
        raise ValueError("rank_by must be a non-empty mapping of columns to 'asc' or 'desc'")
    if any(d not in ("asc", "desc") for d in rank_by.values()):
        raise ValueError("rank_by directions must be 'asc' or 'desc'")
    if len(set(candidates.columns)) < len(candidates.columns):
        raise ValueError("candidates must have unique column names")
    if missing := [c for c in (id, candidate, *rank_by) if c not in candidates.columns]:
        raise ValueError(f"candidates is missing required column(s): {', '.join(missing)}")
    if {id, candidate} & set(rank_by):
        raise ValueError("id and candidate columns cannot also be ranking columns")
    if "resolution_status" in candidates.columns:
        raise ValueError("candidates already contains reserved column 'resolution_status'")
    if nested := [c for c, kind in candidates.dtypes if kind.startswith(("array", "map", "struct"))]:
        raise ValueError(f"candidates must contain scalar columns: {', '.join(nested)}")


def resolution_table(candidates: DataFrame, id: str, candidate: str, rank_by: dict[str, str]) -> DataFrame:
    """One pass: the rows that stay in the running, with resolution_status.

    Best row for each pair, best pairs of each record (all of a tie), then candidates that several records chose alone.
    """
    order, rest = _ranking(rank_by), _all_columns(candidates, list(rank_by))
    held = candidates.filter(_present(candidates, candidate))
    pairs = held.withColumn("__n", F.row_number().over(W.partitionBy(id, candidate).orderBy(*order, *rest))).filter("__n = 1").drop("__n")
    best = pairs.withColumn("__r", F.rank().over(W.partitionBy(id).orderBy(*order))).filter("__r = 1").withColumn("__tied", F.count(F.lit(1)).over(W.partitionBy(id)) > 1)
    # a record alone at its best appears once here, so counting rows counts records
    chosen = best.withColumn("__claims", F.count_if(~F.col("__tied")).over(W.partitionBy(candidate)))
    status = F.when(F.col("__tied"), TIED).when(F.col("__claims") > 1, CONTESTED).otherwise(RESOLVED)
    out = chosen.withColumn("resolution_status", status).drop("__r", "__tied", "__claims")
    return out.unionByName(candidates.filter(~_present(candidates, candidate)).withColumn("resolution_status", F.lit(NO_CANDIDATE)))


@dataclass
class Resolution:
    table: DataFrame  # every row that stays, with resolution_status
    input: DataFrame
    id: str
    candidate: str

    @property
    def resolved(self) -> DataFrame:
        return self.table.filter(F.col("resolution_status") == RESOLVED)

    @property
    def quarantined(self) -> DataFrame:
        return self.table.filter(F.col("resolution_status").isin(TIED, CONTESTED, YIELDED))

    @property
    def unmatched(self) -> DataFrame:
        return self.table.filter(F.col("resolution_status") == NO_CANDIDATE)

    def ordered(self, part: DataFrame) -> DataFrame:
        return part.orderBy(*[F.col(c).asc_nulls_last() for c in (self.id, self.candidate, "resolution_status")])

    def counts(self) -> dict[str, int]:
        s = F.col("resolution_status")
        row = self.table.agg(F.count_if(s == RESOLVED), F.count_if(s.isin(TIED, CONTESTED, YIELDED)), F.count_if(s == NO_CANDIDATE)).first()
        given = self.input.agg(F.count(F.lit(1)), F.count_distinct(F.when(_present(self.input, self.candidate), F.struct(self.id, self.candidate)))).first()
        return {"input_rows": given[0], "distinct_pairs": given[1], "resolved": row[0], "quarantined": row[1], "unmatched": row[2]}


def resolve_one_to_one(candidates: DataFrame, id: str = "id", candidate: str = "candidate", *, rank_by: dict[str, str], eligible: str | None = None, validate: bool = True) -> Resolution:
    """Each record's best candidate if it is alone there and no other record chose it.

    eligible: a boolean column, constant within a record; eligible records resolve first, and others yield what those hold.
    """
    _validate(candidates, id, candidate, rank_by)
    if validate and not candidates.filter(~_present(candidates, id)).isEmpty():
        raise ValueError("record identifiers must be present and non-empty")
    if eligible is None:
        return Resolution(resolution_table(candidates, id, candidate, rank_by), candidates, id, candidate)
    if eligible not in candidates.columns or dict(candidates.dtypes)[eligible] != "boolean" or eligible in (id, candidate, *rank_by):
        raise ValueError("eligible must name one boolean column of candidates, neither id, candidate nor ranking column")
    if validate:
        flags = candidates.groupBy(id).agg(F.count_distinct(eligible).alias("n"), F.count_if(F.col(eligible).isNull()).alias("none"))
        bad = flags.agg(F.max("n"), F.sum("none")).first()
        if bad[1]:
            raise ValueError(f"eligible column '{eligible}' must be boolean with no null")
        if (bad[0] or 0) > 1:
            raise ValueError("eligible must be constant within each record")
    first = resolution_table(candidates.filter(eligible), id, candidate, rank_by)
    held = first.filter(_present(first, candidate)).select(candidate).distinct()
    others = candidates.filter(~F.col(eligible))
    second = resolution_table(others.join(held, candidate, "left_anti").select(candidates.columns), id, candidate, rank_by)
    yielded = others.join(held, candidate, "left_semi").select(candidates.columns).withColumn("resolution_status", F.lit(YIELDED))
    return Resolution(reduce(DataFrame.unionByName, (second, yielded), first), candidates, id, candidate)


def count_rivals(vetoed: DataFrame, won: DataFrame, id: str = "id", validate: bool = True) -> DataFrame:
    """Per id, how many distinct vetoed candidates aren't the one it won; ``won`` has columns id and candidate."""
    _require(vetoed, [id, "vetoed"], "vetoed")
    if validate and not won.groupBy(id).count().filter("count > 1").isEmpty():
        raise ValueError("won must hold one row per id")
    joined = vetoed.select(id, "vetoed").distinct().join(won.select(id, "candidate"), id, "left")
    rival = F.col("candidate").isNull() | (F.col("vetoed") != F.col("candidate"))
    return joined.groupBy(id).agg(F.count_if(rival).cast("int").alias("n_rivals"))


def award_contested(contested: DataFrame, policy: str = "strict_dominance", id: str = "id", candidate: str = "candidate", key: list[str] | str = "rank") -> DataFrame:
    """Which claim on a contested candidate wins.

    strict_dominance: the best claim, if its key differs from the second's; greedy: the best claim; quarantine_all: none.
    A candidate with one claim isn't contested and isn't awarded; an id keeps its first award in order of candidate.
    """
    if policy not in ("strict_dominance", "quarantine_all", "greedy"):
        raise ValueError("policy must be strict_dominance, quarantine_all or greedy")
    keys = [key] if isinstance(key, str) else list(key)
    _require(contested, [id, candidate, *keys], "contested")
    if policy == "quarantine_all":
        return contested.limit(0)
    order = W.partitionBy(candidate).orderBy(*[F.col(c).asc_nulls_last() for c in (*keys, id)], *_all_columns(contested, [*keys, id, candidate]))
    sig = F.struct(*keys)
    ranked = contested.withColumns({"__n": F.row_number().over(order), "__next": F.lead(sig).over(order), "__sig": sig})
    won = ranked.filter("__n = 1 and __next is not null")
    if policy == "strict_dominance":
        won = won.filter(~F.col("__sig").eqNullSafe(F.col("__next")))
    once = W.partitionBy(id).orderBy(F.col(candidate).asc_nulls_last())
    return won.withColumn("__k", F.row_number().over(once)).filter("__k = 1").select(contested.columns)
