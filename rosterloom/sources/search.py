"""Registry search by name: a plan of queries, an injected fetch, and lineage of what found whom."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlencode

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rosterloom
from rosterloom.functions.nicknames import SEED, NicknameDictionary
from rosterloom.functions.vocab import NICKNAME_POLICY
from rosterloom.plans.policy import source_class_permission
from rosterloom.sources.registry_json import parse_licenses, parse_search

PLAN = "plan int, input_first_name string, queried_first_name string, alias_edge_id string, alias_dictionary_version string"


def http_fetch(url: str) -> str:
    """The one place that reaches the network; tests and offline runs pass another function."""
    from urllib.request import urlopen

    with urlopen(url, timeout=60) as answer:
        return answer.read().decode()


def nickname_variants(name: str | None, edges: NicknameDictionary = SEED, max_expansion: int = 25) -> list[tuple[str, str, str | None, str | None]]:
    """(input, queried, edge, version): the normalised name first, then names one recorded edge away, in order."""
    import unicodedata

    if isinstance(max_expansion, bool) or not isinstance(max_expansion, int) or max_expansion < 1:
        raise ValueError("max_expansion must be a single positive integer")
    plain = unicodedata.normalize("NFD", name or "")
    key = " ".join("".join(c for c in plain if not unicodedata.combining(c)).upper().replace(".", "").split())
    if not key:
        return []
    near = sorted({*edges.nicknames.get(key, []), *edges.formals.get(key, [])} - {key})
    rows = [(key, key, None, edges.version), *((key, v, f"{key}>{v}" if v in edges.nicknames.get(key, []) else f"{v}>{key}", edges.version) for v in near)]
    if len(rows) > max_expansion:
        raise ValueError(f"nickname_variants('{key}') would fan out to {len(rows)} queries, above max_expansion = {max_expansion}")
    return rows


@dataclass
class SearchResult:
    providers: DataFrame
    licenses: DataFrame | None
    run_manifest: dict


def npi_search(
    spark: SparkSession, fetch: Callable[[str], str] = http_fetch, *, retrieved: str, first_name: str | None = None, last_name: str | None = None, state: str | None = None,
    postal_code: str | None = None, npi: str | None = None, limit: int = 10, licenses: bool = False, name_expansion: str = "none", source_class: str = "formal_record",
    max_expansion: int = 25, edges: NicknameDictionary = SEED, endpoint: str = "https://npiregistry.cms.hhs.gov/api/",
) -> SearchResult:
    """Queries the registry once for each row of the plan (a few requests) and joins what they found by id."""
    if name_expansion not in ("none", "curated_one_hop"):
        raise ValueError("name_expansion is none or curated_one_hop")
    permission = source_class_permission(source_class)
    if name_expansion == "curated_one_hop" and permission != "review_only":
        raise ValueError(f"name_expansion is gated by {NICKNAME_POLICY['policy_id']}: source class '{source_class}' is '{permission}'")
    if not 1 <= int(limit) <= 200:
        raise ValueError("limit must be between 1 and 200")
    criteria = {"last_name": last_name, "state": state, "postal_code": postal_code, "number": npi}
    if first_name is None and not any(criteria.values()):
        raise ValueError("give at least one search criterion")
    plan = (nickname_variants(first_name, edges, max_expansion) if name_expansion == "curated_one_hop" and first_name is not None else []) or [(first_name, first_name, None, None)]

    def url(first: str | None) -> str:
        named = {"first_name": first, "use_first_name_alias": "False"} if first is not None else {}
        return endpoint + "?" + urlencode({"version": "2.1", "limit": limit} | {k: v for k, v in criteria.items() if v} | named)

    answers = spark.createDataFrame([(i, *row, fetch(url(row[1]))) for i, row in enumerate(plan)], PLAN + ", body string")
    rows = parse_search(answers, "body", retrieved, [c.split()[0] for c in PLAN.split(", ")])
    providers = with_lineage(rows, source_class, name_expansion)
    manifest = {
        "package_version": rosterloom.__version__, "nickname_policy": NICKNAME_POLICY["policy_id"], "dictionary_version": edges.version, "name_expansion": name_expansion,
        "source_class": source_class, "verdict_layer": NICKNAME_POLICY["verdict_layer"],
    }
    return SearchResult(providers, parse_licenses(answers, "body").distinct() if licenses else None, manifest)


def with_lineage(rows: DataFrame, source_class: str, name_expansion: str) -> DataFrame:
    """One row for each id, from the first query that found it, with all queries and edges that did."""
    path = F.coalesce("alias_edge_id", F.when(F.col("queried_first_name").isNotNull(), "input"))
    data = [c for c in rows.columns if c not in ("plan", "npi")]
    met = rows.withColumn("__path", path)
    in_order = lambda c: F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("plan", F.col(c).alias("v")))), lambda e: e["v"])), "|")
    one = met.groupBy("npi").agg(
        F.min_by(F.struct(*data), "plan").alias("r"),
        F.when(F.count("queried_first_name") > 0, in_order("queried_first_name")).alias("found_by_queries"),
        F.when(F.count("__path") > 0, in_order("__path")).alias("found_by_edges"),
    )
    edges = F.col("found_by_edges")
    out = one.select("npi", "r.*", "found_by_queries", "found_by_edges", F.lit(source_class).alias("source_class"), F.lit(name_expansion == "curated_one_hop").alias("candidate_expansion_used"))
    out = out.withColumn("review_only", F.coalesce(~edges.rlike(r"(^|\|)input($|\|)"), F.lit(False)))
    return out.withColumn("acceptance_contribution", F.when(F.col("review_only"), "nickname_only").when(F.coalesce(edges.contains(">"), F.lit(False)), "supporting").otherwise("none"))
