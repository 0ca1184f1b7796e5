"""Joins that state what they may do to the row count, and a ledger of what they did."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("left", "inner", "full", "right")
RELATIONSHIPS = ("one-to-one", "one-to-many", "many-to-one", "many-to-many")


def _pairs(by: str | list[str] | dict[str, str]) -> list[tuple[str, str]]:
    """(column of x, column of y): a dict maps x to y."""
    if isinstance(by, dict):
        return list(by.items())
    return [(b, b) for b in ([by] if isinstance(by, str) else by)]


def _key_counts(df: DataFrame, columns: list[str], out: str) -> DataFrame:
    """Rows for each full key, and one row with null keys for rows that have an absent one."""
    whole = ~_absent(columns)
    keys = [F.when(whole, F.col(c)).alias(f"__k{i}") for i, c in enumerate(columns)]
    return df.select(*keys).groupBy(*[f"__k{i}" for i in range(len(columns))]).agg(F.count(F.lit(1)).alias(out))


def _absent(columns: list[str]) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(c).isNull()
    return out


def join_ledger_entry(x: DataFrame, y: DataFrame, out: DataFrame, by, kind: str, step: str = "join") -> DataFrame:
    """One row: what the join had to give, recomputed from key counts alone, and what it gave."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    pairs = _pairs(by)
    names = [f"__k{i}" for i in range(len(pairs))]
    cx, cy = _key_counts(x, [a for a, _ in pairs], "cx"), _key_counts(y, [b for _, b in pairs], "cy")
    known = F.col("__k0").isNotNull()
    both = cx.filter(known).join(cy.filter(known), names, "full")
    c, d = F.coalesce("cx", F.lit(0)), F.coalesce("cy", F.lit(0))
    keyed = both.agg(
        F.coalesce(F.sum(c * d), F.lit(0)).alias("matched_pairs"), F.coalesce(F.sum(F.when(d == 0, c)), F.lit(0)).alias("ux"), F.coalesce(F.sum(F.when(c == 0, d)), F.lit(0)).alias("uy"),
        F.coalesce(F.max(c * d), F.lit(0)).alias("max_fanout"),
    )
    rows = lambda k, n: k.agg(F.coalesce(F.sum(n), F.lit(0)).alias(f"rows_{n}"), F.coalesce(F.sum(F.when(~known, F.col(n))), F.lit(0)).alias(f"na_{n}"))
    one = keyed.crossJoin(rows(cx, "cx")).crossJoin(rows(cy, "cy")).crossJoin(out.agg(F.count(F.lit(1)).alias("rows_out")))  # one row each
    unmatched_x, unmatched_y = F.col("ux") + F.col("na_cx"), F.col("uy") + F.col("na_cy")
    expected = F.col("matched_pairs") + (unmatched_x if kind in ("left", "full") else 0) + (unmatched_y if kind in ("right", "full") else 0)
    return one.select(
        F.lit(step).alias("step"),
        F.lit(kind).alias("kind"),
        F.lit("+".join(a if a == b else f"{a}={b}" for a, b in pairs)).alias("by"),
        F.col("rows_cx").alias("rows_x"),
        F.col("rows_cy").alias("rows_y"),
        "rows_out",
        expected.alias("rows_expected"),
        "matched_pairs",
        unmatched_x.alias("unmatched_x"),
        unmatched_y.alias("unmatched_y"),
        F.col("na_cx").alias("na_key_x"),
        F.col("na_cy").alias("na_key_y"),
        F.when(F.col("rows_cx") > 0, (F.col("rows_cx") - unmatched_x) / F.col("rows_cx")).alias("match_rate_x"),
        "max_fanout",
        (F.col("rows_out") == expected).alias("conserved"),
    )


@dataclass
class LedgeredJoin:
    result: DataFrame
    ledger: DataFrame


def ledgered_join(x: DataFrame, y: DataFrame, by, kind: str, relationship: str, unmatched: str = "ledger", min_match_rate: float = 0.0, step: str = "join") -> LedgeredJoin:
    """Joins on equal keys; absent keys match nothing but keep their rows on an outer side. Violations raise before use."""
    if kind not in KINDS:
        raise ValueError(f"kind is one of {', '.join(KINDS)}")
    if relationship not in RELATIONSHIPS:
        raise ValueError(f"relationship must be declared: {', '.join(RELATIONSHIPS)}")
    if unmatched not in ("ledger", "error"):
        raise ValueError("unmatched is 'ledger' or 'error'")
    pairs = _pairs(by)
    if missing := [a for a, _ in pairs if a not in x.columns] + [b for _, b in pairs if b not in y.columns]:
        raise ValueError(f"join keys missing: {', '.join(dict.fromkeys(missing))}")
    for side, df, columns, alone in (("x", x, [a for a, _ in pairs], ("one-to-one", "one-to-many")), ("y", y, [b for _, b in pairs], ("one-to-one", "many-to-one"))):
        if relationship in alone:
            twice = _key_counts(df, columns, "n").filter("n > 1 and __k0 is not null")
            if some := twice.limit(3).collect():
                keys = ", ".join("+".join(str(v) for v in r[:-1]) for r in some)
                raise ValueError(f"relationship '{relationship}' declares {side} keys unique, but {twice.count()} repeat (e.g. {keys})")
    renamed = {b: f"__y_{i}" for i, (_, b) in enumerate(pairs)}
    clash = {c: f"{c}_y" for c in y.columns if c in x.columns and c not in renamed}
    right = y.withColumnsRenamed(renamed | clash)
    condition = [x[a] == right[f"__y_{i}"] for i, (a, _) in enumerate(pairs)]
    joined = x.join(right, condition, kind)
    keys = [F.coalesce(x[a], right[f"__y_{i}"]).alias(a) if kind in ("full", "right") else x[a] for i, (a, _) in enumerate(pairs)]
    first = [a for a, _ in pairs]
    result = joined.select(*keys, *[x[c] for c in x.columns if c not in first], *[right[c] for c in right.columns if not c.startswith("__y_")])
    ledger = join_ledger_entry(x, y, result, by, kind, step)
    row = ledger.first()
    if not row["conserved"]:
        raise AssertionError(f"step '{step}': expected {row['rows_expected']} rows, got {row['rows_out']}")
    if unmatched == "error":
        for side, kinds in (("x", ("inner", "right")), ("y", ("inner", "left"))):
            if kind in kinds and row[f"unmatched_{side}"]:
                raise ValueError(f"step '{step}': {kind} drops {row[f'unmatched_{side}']} unmatched {side} row(s), and unmatched = 'error'")
    if min_match_rate > 0 and row["match_rate_x"] is not None and row["match_rate_x"] < min_match_rate:
        raise ValueError(f"step '{step}': match rate {row['match_rate_x']:.3f} below the declared minimum {min_match_rate:.3f}")
    return LedgeredJoin(result, ledger)
