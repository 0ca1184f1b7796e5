"""Registry JSON, search with an injected fetch, nickname policy, and rosters as a stream."""

import json

import pytest

from rosterloom.plans.policy import assert_nickname_policy, source_class_permission
from rosterloom.sources import registry_json, search

BASIC = {"first_name": "JANE", "last_name": "DOE", "middle_name": "--", "credential": "", "sex": "F", "enumeration_date": "2006-05-23", "last_updated": "2020-01-01"}
PROVIDER = {
    "number": "1234567893", "basic": BASIC, "addresses": [{"address_purpose": "MAILING", "state": "NY", "postal_code": "100010000"}, {"address_purpose": "LOCATION", "state": "CO", "postal_code": "802101234"}],
    "taxonomies": [{"code": "207V", "desc": "OB", "primary": True, "state": "CO", "license": "A1"}, {"code": "207Q", "desc": "FM", "primary": False, "state": "CO", "license": None}],
}
OTHER = {"number": "1245319599", "basic": {"first_name": "ROB"}, "addresses": [], "taxonomies": []}


def answer(*providers):
    return json.dumps({"result_count": len(providers), "results": list(providers)})


def test_parse(spark):
    df = spark.createDataFrame([(answer(PROVIDER, OTHER),), (answer(),)], "body string")
    got = {r["npi"]: r for r in registry_json.parse_search(df, "body", "2026-05-24").collect()}
    a, b = got["1234567893"], got["1245319599"]
    assert (a["first"], a["middle"], a["credential"], a["gender"], a["zip"], a["zip_full"], a["state"], a["years_enumerated"], a["retrieved"]) == ("JANE", None, None, "F", "80210", "802101234", "CO", 20, "2026-05-24")
    assert (b["state"], b["zip"], b["gender"], b["years_enumerated"]) == (None, None, None, None)
    assert [tuple(r) for r in registry_json.parse_licenses(df, "body").collect()] == [("1234567893", "CO", "A1", "207V", "OB", True)]
    with pytest.raises(ValueError, match="bad request"):
        registry_json.parse_search(spark.createDataFrame([('{"Errors":[{"description":"bad request"}]}',)], "body string"), "body", "2026-01-01")


def test_search_lineage(spark):
    asked = []

    def fetch(url):
        asked.append(url)
        return answer(PROVIDER, OTHER) if "first_name=BOB" in url else answer(OTHER) if "first_name=ROBERT" in url else answer()

    found = search.npi_search(spark, fetch, retrieved="2026-01-01", first_name="Bob", last_name="Doe", name_expansion="curated_one_hop", source_class="informal_capable", licenses=True)
    got = {r["npi"]: r for r in found.providers.collect()}
    assert len(asked) == 2 and all("use_first_name_alias=False" in u for u in asked)
    assert got["1245319599"]["found_by_queries"] == "BOB|ROBERT" and got["1245319599"]["found_by_edges"] == "input|ROBERT>BOB" and got["1245319599"]["acceptance_contribution"] == "supporting"
    assert got["1234567893"]["acceptance_contribution"] == "none" and found.licenses.count() == 1
    only = search.npi_search(spark, lambda u: answer(OTHER) if "ROBERT" in u else answer(), retrieved="2026-01-01", first_name="Bob", last_name="Doe", name_expansion="curated_one_hop", source_class="informal_capable")
    row = only.providers.first()
    assert row["review_only"] and row["acceptance_contribution"] == "nickname_only"
    with pytest.raises(ValueError, match="VIOLATION"):
        assert_nickname_policy(only.providers)
    assert_nickname_policy(found.providers)
    with pytest.raises(ValueError, match="lineage column"):
        assert_nickname_policy(found.providers.drop("found_by_edges"))


def test_search_refusals(spark):
    ok = dict(retrieved="2026-01-01", first_name="Bob")
    for args in (dict(name_expansion="curated_one_hop"), dict(name_expansion="curated_one_hop", source_class="unknown"), dict(limit=0), dict(limit=201), dict(name_expansion="x"), dict(first_name=None)):
        with pytest.raises(ValueError):
            search.npi_search(spark, lambda u: answer(), **(ok | args))
    with pytest.raises(ValueError, match="fan out"):
        search.nickname_variants("ELIZABETH", max_expansion=2)
    assert search.nickname_variants("al")[1:] == [("AL", "ALBERT", "ALBERT>AL", "seed-1"), ("AL", "ALEXANDER", "ALEXANDER>AL", "seed-1")]
    assert search.nickname_variants("") == [] and source_class_permission("what") == "fail_closed"


def test_roster_stream(spark, tmp_path):
    from rosterloom.streaming.roster_stream import match_stream
    from test_match import MAPPED, REASONS, tables

    roster, registry = tables(spark)
    roster.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(roster.schema).parquet(str(tmp_path / "in"))
    query = match_stream(stream, registry, str(tmp_path / "out"), str(tmp_path / "check"), **MAPPED)
    query.awaitTermination(300)
    assert {r["record"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == REASONS


def test_sinks(spark, tmp_path):
    from rosterloom.sources.registry import read_registry, save_source_table, write_match
    from rosterloom.operators.match import match_npi
    from test_match import MAPPED, tables

    roster, registry = tables(spark)
    write_match(match_npi(roster, registry, **MAPPED), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m/matches")).count() == 3
    save_source_table(registry, str(tmp_path / "r"))
    assert read_registry(spark, str(tmp_path / "r/csv"), ["provider", "type"], "csv", header="true").columns == ["provider", "type"]
