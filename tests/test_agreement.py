"""Verdict rules: contracts, pinned verdicts, and properties over a pool of names."""

import random

import pytest
from pyspark.sql import functions as F

from rosterloom.functions import agreement as ag
from rosterloom.functions import tokens as tk
from rosterloom.functions.nicknames import SEED, NicknameDictionary
from rosterloom.plans import contracts

Y, N, U = "corroborates", "conflicts", "uninformative"

# Pinned verdicts by rule, beyond those of the contracts.
PINNED = {
    "middle": [
        ("B", "BETH", Y), ("WORKMAN", "G", N), ("MARIE LEFEVER", "MARIE", Y), ("MARIE-LEFEVER", "MARIE", N), ("ERICKSON-OWENS", "ERICKSON OWENS", Y), ("ERICKSON-OWENS", "ERICKSONOWENS", Y),
        ("M. L.", "MARIE-LEFEVER", Y), ("646-704-2003", "MARIE", U), ("-", "A", U), ("ML", "MARIE LEFEVER", Y), ("MLXYZ", "MARIE LEFEVER", N),
    ],
    "nickname": [
        ("AL", "ALEXANDER", Y), ("k.c.", "CASEY", Y), ("RICK", "RICHARD", Y), ("KATIE", "KATHERINE", Y), ("PEG", "MARGARET", Y), ("NANCY", "ANN", Y), ("MARVIN", "MORRIS", N), ("GEORGE", "GRETA", N),
        ("CHRISTINA", "CHRISTOPHER", N), ("PATRICIA", "PATRICK", N), ("DANIELLE", "DANIEL", N), ("KATE", "CATHERINE", Y), ("BARB", "BARBARA", Y), ("POUL-HENNING", "POUL", N),
    ],
    "suffix": [("2ND", "Jr.", Y), ("III", "3rd", Y), ("SENIOR", "snr", Y)],
    "surname": [
        ("HARVEY CAPISTA", "CAPISTA", Y), ("Gener Montan", "GENER BETANCOURT", N), ("A.", "A.", Y), ("Van", "van Erven", N), ("Smith-Jones", "Jones Smith", Y),
    ],
}


@pytest.mark.parametrize("contract", contracts.ALL, ids=lambda f: f.__name__)
def test_contracts_hold(spark, contract):
    contract(spark)


def test_contracts_notice_broken_rules(spark):
    broken = [
        (contracts.assert_gender_agreement_contract, lambda a, b: F.when(F.upper(a) == F.upper(b), Y).otherwise(N)),
        (contracts.assert_suffix_agreement_contract, lambda a, b: ag.verdict(ag.normalize_suffix(a).isNotNull() & ag.normalize_suffix(b).isNotNull(), ag.normalize_suffix(a) == ag.normalize_suffix(b))),
        (contracts.assert_license_agreement_contract, lambda a, sa, b, sb: F.when(ag.normalize_license(a) == ag.normalize_license(b), Y).otherwise(U)),
        (contracts.assert_nickname_agreement_contract, lambda a, b: ag.nickname_agreement(a, b, NicknameDictionary(()))),
        (contracts.assert_license_status_contract, lambda x: ag.normalize_license_status(x, {"active": ["ACTIVE"]})),
        (contracts.assert_org_name_matches_person_contract, lambda a, b: F.coalesce(ag.org_name_matches_person(a, b), F.lit(False))),
    ]
    for contract, rule in broken:
        with pytest.raises(AssertionError):
            contract(spark, rule)


def test_pinned_verdicts(spark):
    rules = {
        "middle": lambda a, b: ag.middle_agreement(tk.middle_tokens(a), tk.middle_tokens(b)), "nickname": ag.nickname_agreement, "suffix": ag.suffix_agreement,
        "surname": lambda a, b: ag.surname_agreement(a, b)["verdict"],
    }
    for name, cases in PINNED.items():
        rows = [(i, a, b) for i, (a, b, _) in enumerate(cases)]
        got = {r["i"]: r["v"] for r in spark.createDataFrame(rows, "i int, a string, b string").select("i", rules[name]("a", "b").alias("v")).collect()}
        assert [got[i] for i in range(len(cases))] == [v for *_, v in cases], name


def test_alternates_rescue(spark):
    df = spark.createDataFrame([("SMITH", "JONES", ["Jones-Lee"], None), ("SMITH", "LEE", [""], None), ("SMITH", "BROWN", None, ["smith"])], "a string, b string, x array<string>, y array<string>")
    got = [tuple(r["v"]) for r in df.select(ag.surname_agreement("a", "b", alternates_a="x", alternates_b="y").alias("v")).collect()]
    assert got == [(Y, "alternate_recorded"), (N, None), (Y, "alternate_recorded")]


def test_given_modes(spark):
    df = spark.createDataFrame([("R", "Robert"), ("R", "R"), ("Bob", "Robert"), ("Ann Mary", "Mary"), ("", "Ann"), ("Mary-Jane", "Jane")], "a string, b string")
    out = df.select(
        ag.names_have_compatible_given("a", "b", mode="positional_ie").alias("p"), ag.names_have_compatible_given("a", "b", mode="any_token").alias("t"), ag.name_given_match_position("a", "b").alias("w")
    ).collect()
    assert [r["p"] for r in out] == [True, False, True, False, False, False]
    assert [r["t"] for r in out] == [False, False, False, True, False, False]
    assert [r["w"] for r in out] == [None, None, None, "one_leading", None, None]
    with pytest.raises(TypeError):
        ag.names_have_compatible_given("a", "b")
    with pytest.raises(ValueError):
        ag.names_have_compatible_given("a", "b", mode="x")


def test_properties_over_a_pool(spark):
    """Closed verdicts, symmetry, absence decides nothing, a recorded value never conflicts with itself."""
    rnd = random.Random(11)
    pool = [None, "", " ", "A", "B.", "ANN", "Ann-Marie", "MARIE ANN", "O'Neil", "ONEIL", "van Erven", "Van", "JR", "M", "F", "Müller", "Smith (Jones)", "-", "9", "BOB", "ROBERT", "de la Cruz"]
    rows = [(rnd.choice(pool), rnd.choice(pool)) for _ in range(150)] + [(p, p) for p in pool]
    df = spark.createDataFrame(rows, "a string, b string")
    rules = {
        "middle": lambda a, b: ag.middle_agreement(tk.middle_tokens(a), tk.middle_tokens(b)), "gender": ag.gender_agreement, "nickname": ag.nickname_agreement, "suffix": ag.suffix_agreement,
        "surname": lambda a, b: ag.surname_agreement(a, b)["verdict"], "given": lambda a, b: ag.given_name_agreement(a, b)["verdict"],
    }
    for name, rule in rules.items():
        for r in df.select("a", "b", rule("a", "b").alias("x"), rule("b", "a").alias("y")).collect():
            assert r["x"] in (Y, N, U) and r["x"] == r["y"], (name, r)
            if not r["a"] or not r["b"]:
                assert r["x"] == U, (name, r)
            if r["a"] == r["b"]:
                assert r["x"] != N, (name, r)


def test_nickname_dictionary(spark):
    assert SEED.canonical_name("AL") == "ALBERT" and SEED.canonical_name("ZZ") == "ZZ" and SEED.nicknames_of("JAMES") == ["JAMIE", "JIM", "JIMMY"]
    big = NicknameDictionary(tuple((f"FORMAL{i}", f"NICK{i}") for i in range(400)))
    df = spark.createDataFrame([("NICK7",), ("X",), (None,)], "t string")
    got = {r["t"]: r["r"] for r in big.attach_roots(df, "t", "r").collect()}
    assert got == {"NICK7": ["NICK7", "FORMAL7"], "X": ["X"], None: None}
    with pytest.raises(ValueError):
        big.roots(F.col("t"))
    assert NicknameDictionary.from_frame(SEED.frame(spark)).formals["AL"] == ["ALBERT", "ALEXANDER"]
    assert [r[0] for r in spark.createDataFrame([("AL",), ("KATE",), ("X",)], "t string").select(SEED.canonical("t")).collect()] == ["ALBERT", "CATHERINE", "X"]


def test_no_similarity_of_spelling_anywhere():
    from pathlib import Path

    import rosterloom

    root = Path(rosterloom.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.parts:
            text = p.read_text().lower()
            assert not any(w in text for w in ("levenshtein", "soundex", "jaro", "metaphone")), p
