"""Contracts: closed expectations that a rule, or a stand-in for it, must meet.

Each contract builds one frame of cases, applies the rule's column, and compares; a difference raises AssertionError.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from rosterloom.functions import agreement as ag
from rosterloom.functions import tokens as tk

Y, N, U = ag.CORROBORATES, ag.CONFLICTS, ag.UNINFORMATIVE

# Inputs and the verdict that is due.
MIDDLE = [
    ("A REINHARD", "REINHARD", Y), ("BETH HARVEY", "H", Y), ("M", "ANN MARIE", Y), ("VL", "VELMA LAURITZEN", Y), ("MJ", "MARY JANE", Y), ("VL", "LAURITZEN VELMA", N), ("JANE", "DENISE", N),
    ("MARILYN", "F", N), ("JANE", "JOAN", N), ("JULIA", "JULIE", N), ("ELISABETH", "ELIZABETH", N), ("", "MARIE", U), (None, "MARIE", U), ("", "", U),
]
GENDER = [("Female", "F", Y), (" male ", "M", Y), ("M", "F", N), ("FEMALE", "MALE", N), ("U", "F", U), ("", "M", U), (None, "F", U), ("1", "M", U), ("2", "F", U)]
NICKNAME = [
    ("BETH", "ELIZABETH", Y), ("ELIZABETH", "LIZ", Y), ("BOB", "BOBBY", Y), ("ALBERT", "ALEXANDER", N), ("AL", "ALBERT", Y), ("ELISABETH", "ELIZABETH", N), ("JANE", "JOAN", N), ("J", "JAMES", Y),
    ("J", "ROBERT", N), ("ROBERT", "WILLIAM", N), ("HAROLD", "HENRY", N), ("", "MARY", U), (None, "MARY", U),
]
SUFFIX = [("JR", "SR", N), ("II", "III", N), ("JR", "II", Y), ("Jr.", "JUNIOR", Y), (None, "JR", U), ("", "SR", U), ("V", "IV", U)]
LICENSE = [("MD-12345", "CO", "md 12345", "co", Y), ("12345", "CO", "12345", "TX", U), ("12345", "CO", "99999", "CO", U), ("0052", "CO", "52", "CO", U), ("12345", "CO", None, "CO", U), ("12345", None, "12345", "CO", U)]
SURNAME = [("MCCARTHY-DERVIN", "MCCARTHY", Y), ("LEE", "LEE", Y), ("O'BRIEN", "OBRIEN", Y), ("ABU-GHAZALEH", "ABUGHAZALEH", Y), ("DE LA CRUZ", "DE LEON", N), ("LEE", "SMITH", N), ("", "SMITH", U), (None, "SMITH", U)]
SURNAME_REASONS = {"exact", "separator_equivalent", "concatenated_equivalent", "component_subset", "alternate_recorded", "maiden_as_middle"}
LICENSE_STATUS = [
    ("Deceased", "deceased"), ("DECEASED", "deceased"), ("Surrendered", "disciplinary"), ("Revoked", "disciplinary"), ("Voluntary Surrender", "disciplinary"), ("Expired", "lapsed"), ("Inactive", "lapsed"),
    ("Retired", "retired"), ("EMERITUS", "retired"), ("Active", "active"), ("Probation", "restricted"), ("Status 47", None), ("", None), (None, None),
]
ORG_NAME = [
    ("NADINE H. YASSA, M.D., INC.", "Nadine H. Yassa", True), ("ECHO PARK PHARMACY", "Tarek Mohammad Ebrahim", False), ("MEDICAL GROUP INC", "J. MD", None),
    ("ABBAS-RODRIGUEZ MEDICAL GROUP", "Maria Abbas Rodriguez", True), ("Do Family Medicine Clinic", "Anh Do", True),
]
GIVEN = [
    ("SMITH", "SMITH", Y, "exact"), ("Smith", " SMITH ", Y, "exact"), ("SMITH", "JONES", N, None), (None, "SMITH", U, None), (None, None, U, None), ("", "SMITH", U, None), ("BOB", "ROBERT", Y, "nickname"),
    ("JULIA", "JULIE", Y, "nickname"), ("LEE", "LEA", N, None), ("R", "ROBERT", Y, "initial"), ("R", "WILLIAM", N, None), ("ALBERT", "ALEXANDER", N, None),
]


def _check(spark: SparkSession, name: str, cases: list[tuple], inputs: int, column: Callable[..., Column]) -> None:
    """The last len(case) - inputs values of a case are due from ``column``, as a struct if there are several."""
    fields = ", ".join(f"c{i} string" for i in range(inputs))
    df = spark.createDataFrame([(k, *case[:inputs]) for k, case in enumerate(cases)], f"k int, {fields}")
    got = {r["k"]: r["v"] for r in df.select("k", column(*[F.col(f"c{i}") for i in range(inputs)]).alias("v")).collect()}
    for k, case in enumerate(cases):
        due = case[inputs:]
        found = tuple(got[k]) if len(due) > 1 else (got[k],)
        if found != tuple(due):
            raise AssertionError(f"{name} contract: {case[:inputs]} gave {found}, expected {tuple(due)}")


def assert_middle_agreement_contract(spark, fn=ag.middle_agreement, tokens=tk.middle_tokens) -> None:
    _check(spark, "middle_agreement", MIDDLE, 2, lambda a, b: fn(tokens(a), tokens(b)))


def assert_gender_agreement_contract(spark, fn=ag.gender_agreement) -> None:
    _check(spark, "gender_agreement", GENDER, 2, fn)


def assert_nickname_agreement_contract(spark, fn=ag.nickname_agreement) -> None:
    _check(spark, "nickname_agreement", NICKNAME, 2, fn)


def assert_suffix_agreement_contract(spark, fn=ag.suffix_agreement) -> None:
    _check(spark, "suffix_agreement", SUFFIX, 2, fn)


def assert_license_agreement_contract(spark, fn=ag.license_agreement) -> None:
    _check(spark, "license_agreement", LICENSE, 4, fn)


def assert_surname_agreement_contract(spark, fn=ag.surname_agreement) -> None:
    """The verdicts, the maiden-name rescue, and a reason from the vocabulary exactly where a verdict corroborates."""
    _check(spark, "surname_agreement", SURNAME, 2, lambda a, b: fn(a, b)["verdict"])
    _check(spark, "surname_agreement", [("RYE", "REINHARD", "REINHARD", "A", Y, "maiden_as_middle")], 4, lambda a, b, ma, mb: fn(a, b, ma, mb))
    df = spark.createDataFrame([c[:2] for c in SURNAME], "a string, b string")
    for r in df.select(fn("a", "b").alias("v")).collect():
        if (r["v"]["reason"] is not None) != (r["v"]["verdict"] == Y) or (r["v"]["reason"] is not None and r["v"]["reason"] not in SURNAME_REASONS):
            raise AssertionError(f"surname_agreement contract: verdict {r['v']['verdict']} with reason {r['v']['reason']}")


def assert_license_status_contract(spark, fn=ag.normalize_license_status) -> None:
    _check(spark, "license_status", LICENSE_STATUS, 1, fn)


def assert_org_name_matches_person_contract(spark, fn=ag.org_name_matches_person) -> None:
    _check(spark, "org_name_matches_person", ORG_NAME, 2, fn)


def assert_given_name_agreement_contract(spark, fn=ag.given_name_agreement) -> None:
    _check(spark, "given_name_agreement", GIVEN, 2, fn)


ALL = [f for n, f in sorted(globals().items()) if n.startswith("assert_")]
