"""Where nickname evidence may lead: candidate expansion by source class, and what may never be accepted on it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterloom.functions.vocab import NICKNAME_POLICY, SOURCE_CLASSES

LINEAGE = ["source_class", "candidate_expansion_used", "review_only", "acceptance_contribution", "found_by_queries", "found_by_edges", "alias_edge_id", "alias_dictionary_version"]


def source_class_permission(name: str | None) -> str:
    return SOURCE_CLASSES.get(name, "fail_closed")


def assert_nickname_policy(accepted: DataFrame) -> DataFrame:
    """``accepted`` unchanged, or an error where a row's lineage is missing or rests on a nickname alone."""
    if missing := [c for c in LINEAGE if c not in accepted.columns]:
        raise ValueError(f"frame is missing lineage column(s): {', '.join(missing)}")
    used = F.coalesce(F.col("candidate_expansion_used"), F.lit(False))
    needed = [c for c in LINEAGE if c not in ("candidate_expansion_used", "alias_edge_id")]
    bad = F.coalesce(F.col("review_only"), F.lit(False)) | F.coalesce(F.col("acceptance_contribution") == "nickname_only", F.lit(False))
    row = accepted.agg(*[F.count_if(used & F.col(c).isNull()).alias(c) for c in needed], F.count_if(bad).alias("__bad")).first()
    for c in needed:
        if row[c]:
            raise ValueError(f"NICKNAME POLICY VIOLATION: lineage field '{c}' is missing on {row[c]} expansion-influenced row(s)")
    if row["__bad"]:
        some = accepted.filter(bad).select("npi", "found_by_edges").orderBy("npi").limit(5).collect()
        raise ValueError(
            f"NICKNAME POLICY VIOLATION: {row['__bad']} candidate(s) whose only evidence is nickname expansion (policy {NICKNAME_POLICY['policy_id']}: {NICKNAME_POLICY['auto_accept_rule']}). "
            f"NPIs: {', '.join(str(r['npi']) for r in some)}; edges: {'; '.join(dict.fromkeys(str(r['found_by_edges']) for r in some))}. Route these to clerical review."
        )
    return accepted
