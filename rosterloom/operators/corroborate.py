"""Corroboration of claimed provider ids against a registry snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.agreement import org_name_matches_person
from rosterloom.functions.text import npi_luhn_ok

SNAPSHOT = {"npi": "npi", "last_name": "last_name", "first_name": "first_name", "org_name": "org_name", "state": "state"}


def npi_corroborate(claims: DataFrame, npi: str, snapshot: DataFrame, name: str | None = None, state: str | None = None, snapshot_cols: dict[str, str] | None = None, validate: bool = True) -> DataFrame:
    """``claims`` with structurally_valid, in_snapshot, name_match, state_match and confidence.

    confidence: invalid, corroborated, unverified, or null for a null id. The snapshot has one row for each id.
    """
    cols = SNAPSHOT if snapshot_cols is None else snapshot_cols
    if cols["npi"] not in snapshot.columns:
        raise ValueError(f"snapshot lacks the NPI column '{cols['npi']}'")
    if validate and not snapshot.groupBy(cols["npi"]).count().filter("count > 1").isEmpty():
        raise ValueError("snapshot holds duplicate NPIs")
    have = {role: c for role, c in cols.items() if role != "npi" and c in snapshot.columns}
    snap = snapshot.select(F.col(cols["npi"]).cast("string").alias("__npi"), *[F.col(c).cast("string").alias(f"__{role}") for role, c in have.items()])
    own = F.col(npi).cast("string")
    joined = claims.join(snap, own == F.col("__npi"), "left")
    valid, known = npi_luhn_ok(own), F.when(own.isNotNull(), F.col("__npi").isNotNull())
    none = F.lit(None).cast("boolean")
    pieces = [F.coalesce(f"__{r}", F.lit("")) for r in ("last_name", "first_name", "org_name") if r in have]
    named = none if name is None or not pieces else org_name_matches_person(F.nullif(F.trim(F.concat_ws(" ", *pieces)), F.lit("")), name)
    norm = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    stated = none if state is None or "state" not in have else norm(F.col(state)) == norm(F.col("__state"))
    confidence = F.when(valid == F.lit(False), "invalid").when(valid & known, "corroborated").when(valid & ~known, "unverified")
    added = {"structurally_valid": valid, "in_snapshot": known, "name_match": named, "state_match": stated, "confidence": confidence}
    return joined.withColumns(added).drop("__npi", *[f"__{r}" for r in have])
