"""Normalisation, tokens and parsing on tables of cases, one frame for each."""

import unicodedata

import duckdb
import pytest
from pyspark.sql import functions as F

from rosterloom.functions import agreement as ag
from rosterloom.functions import text as tx
from rosterloom.functions import tokens as tk
from rosterloom.functions.parse import parse_person, strip_name_noise
from rosterloom.functions.schools import strip_med_suffix
from rosterloom.plans import sql_text as st


def values(spark, inputs, column, schema="x string"):
    rows = [(i, *(x if isinstance(x, tuple) else (x,))) for i, x in enumerate(inputs)]
    return [r["v"] for r in spark.createDataFrame(rows, f"i int, {schema}").select("i", column.alias("v")).orderBy("i").collect()]


def test_every_latin_letter_as_the_sql_twin(spark):
    points = [chr(p) for p in range(0xC0, 0x180)]
    names = [f"a{c}b" for c in points] + [unicodedata.normalize("NFD", f"a{c}b") for c in points]
    got = values(spark, names, tx.normalize_string("x"))
    con = duckdb.connect()
    want = [con.execute(f"SELECT {st.sql_npi_name('x')} FROM (SELECT ?::VARCHAR AS x)", [n]).fetchone()[0] for n in names]
    assert got == want


def test_name_keys(spark):
    cases = {"Müller-Lüdenscheidt": "MUELLER-LUEDENSCHEIDT", "C(arolyn) Smith": "CAROLYN SMITH", "Ann (Annie) Lee": "ANN LEE", "Ann (Annie": "ANN", "x ] y": "X Y", "  a \t b ": "A B", "B.": "B.", "": "", None: None, "Øyvind Łukasz": "OYVIND LUKASZ", "O’Neil": "O'NEIL"}
    assert values(spark, list(cases), tx.name_key("x")) == list(cases.values())
    assert values(spark, ["ABBAS--RODRIGUEZ", "A - B"], tx.name_key("x", fold_hyphens=True)) == ["ABBAS RODRIGUEZ", "A B"]
    assert values(spark, ["O'Brien", "O Brien", None], tx.normalize_string("x", True, True)) == ["OBRIEN", "OBRIEN", None]
    assert values(spark, ["(x)", "9a", "", None], tx.extract_first_initial("x")) == ["X", "A", None, None]
    assert values(spark, ["9a", "", None], tx.first_initial("x")) == ["9", None, None]
    assert [tuple(v) for v in values(spark, ["B. Ann, Lee", None, "Jo"], tx.split_given("x"))] == [("B", "ANN LEE"), ("", ""), ("JO", "")]
    assert values(spark, ["SMITH MD", "DO", "SMITH MD, JR.", "DOOLEY", "JR"], tx.compact_name_key("x", strip_suffixes=True)) == ["SMITH", "DO", "SMITHMD", "DOOLEY", "JR"]


def test_surname_key_variants(spark):
    got = values(spark, ["Van Hook", "GOODYEAR V", "Le", "O'Brien", None, "-"], tx.surname_key_variants("x"))
    assert [tuple(v) for v in got] == [("VANHOOK", "HOOK"), ("GOODYEAR", "GOODYEAR"), ("LE", "LE"), ("OBRIEN", "OBRIEN"), (None, None), (None, None)]


def test_ids(spark):
    ids = ["1234567893", "1234567890", "3234567893", "123456789", "1234567893.5", "", None]
    assert values(spark, ids, tx.npi_luhn_ok("x")) == [True, False, False, False, False, False, None]
    df = spark.createDataFrame([(1234567893.0,), (1234567893.5,), (None,)], "x double")
    assert [r[0] for r in df.select(tx.npi_text(df, "x")).collect()] == ["1234567893", "1.2345678935E9", None]
    assert values(spark, ["ids 1234567893, 1234567890 and 1234567893", None], tx.extract_npis("x")) == [["1234567893"], []]


def test_frames(spark):
    df = spark.createDataFrame([("O'Brien", "Ann"), (None, " x")], "last_name string, first_name string")
    out = tx.normalize_physician_names(df, advanced_norm=True).collect()
    assert [r["last_clean"] for r in out] == ["OBRIEN", None] and [r["middle_clean"] for r in out] == [None, None] and [r["first_initial"] for r in out] == ["A", "X"]
    assert tx.normalize_name_columns(df, ["last_name"]).columns[-1] == "last_name_norm"
    with pytest.raises(ValueError, match="Missing columns: nope"):
        tx.normalize_name_columns(df, ["nope"])
    assert tx.needs_normalization(df, "first_name") and not tx.needs_normalization(df.filter("false"), "first_name")


def test_tokens(spark):
    assert values(spark, ["DE LA CRUZ GARCIA", "O'NEIL LEE", None], tk.surname_tokens("x")) == [["CRUZ", "GARCIA"], ["O'NEIL"], []]
    assert values(spark, ["646-704-2003", "-", "Mary-Jane A", ""], tk.middle_tokens("x")) == [[], [], ["MARY-JANE", "A"], []]
    assert values(spark, ["Ann B --", None], tk.given_tokens("x")) == [["ANN"], []]
    assert values(spark, ["- Mary-Jane", "--", "B.", None], tk.name_leading_given("x")) == ["MARY-JANE", None, "B", None]
    assert values(spark, ["ABC", "AB", "AAB"], tk.deletions(F.col("x"))) == [["ABC", "BC", "AC", "AB"], [], ["AAB", "AB", "AA"]]


def test_parse_person(spark):
    # pinned parses: first, middle, last, suffix
    cases = {
        "Ann M. Barbaccia, CNM": ("ANN", "M", "BARBACCIA", ""), "Jon W Williams": ("JON", "W", "WILLIAMS", ""), "JAMES VAN DER BEEK": ("JAMES", "", "VAN DER BEEK", ""), "Cher": ("CHER", "", "", ""),
        "G.R.Dobbs": ("G", "R", "DOBBS", ""), "Nguyen Van Do": ("NGUYEN", "", "VAN DO", ""), "Do, Nguyen Van": ("NGUYEN", "", "VAN DO", ""), "John Michael Ma": ("JOHN", "", "MICHAEL MA", ""),
        "John Ma": ("JOHN", "", "MA", ""), "Do, Anh, M.D.": ("ANH", "", "DO", ""), "John Michael Smith DO": ("JOHN", "MICHAEL", "SMITH", ""), "Robert Smith Jr.": ("ROBERT", "", "SMITH", "JR"),
        "Sr. Mary Josephine, CNM": ("MARY", "", "JOSEPHINE", ""), "Álvarez, María": ("MARIA", "", "ALVAREZ", ""), "MD": ("", "", "", ""), "": ("", "", "", ""), None: ("", "", "", ""),
    }
    assert [tuple(v) for v in values(spark, list(cases), parse_person("x"))] == list(cases.values())
    turned = {"FINCH SHANNON RN": ("SHANNON", "", "FINCH", ""), "DE LA CRUZ JUAN": ("JUAN", "", "DE LA CRUZ", ""), "FINCH, SHANNON": ("SHANNON", "", "FINCH", ""), "CHER": ("CHER", "", "", "")}
    assert [tuple(v) for v in values(spark, list(turned), parse_person("x", "surname_first"))] == list(turned.values())
    noise = {"Jane Doe, D.D.S.": "Jane Doe", "Ann Poe, PA-C": "Ann Poe", "Dr. Jane Doe": "Jane Doe", "Do, Anh": "Do Anh", "John Smith MA": "John Smith", None: None}
    assert values(spark, list(noise), strip_name_noise("x")) == list(noise.values())


def test_codes(spark):
    assert [tuple(v) for v in values(spark, ["Robert Smith, Jr.", "Sr. Mary", "A III B JR", None, ""], ag.extract_suffix("x"))] == [("Robert Smith", "JR"), ("Sr. Mary", None), ("A B", "JR"), (None, None), ("", None)]
    assert values(spark, ["MD-1.2 3", "", "0052", None], ag.normalize_license("x")) == ["MD123", None, "0052", None]
    got = values(spark, ["MD-123X", "ABC", "12A34", None], ag.license_anatomy("x"))
    assert [tuple(v)[1:] for v in got] == [("MD123X", "MD", "123", "X", "MD###X", 3), ("ABC", "ABC", None, "", "ABC", 0), ("12A34", "", "12A34", "", "##A##", 4), (None,) * 6]
    assert values(spark, ["M.D.", "DO, PhD", "md/md", "chief", None], ag.normalize_credential("x")) == ["MD", "DO, PHD", "MD", "", ""]
    bands = [("1990", "1990"), ("1990", "1989"), ("1990", "1991"), ("1990", "1988"), ("1990", "1993"), ("1990", "1980"), ("1990", "2001"), (None, "1990"), ("x", "1")]
    want = ["corroborates"] * 3 + ["uninformative"] * 3 + ["conflicts"] + ["uninformative"] * 2
    assert values(spark, bands, ag.graduation_year_agreement("c", "g"), "c string, g string") == want
    tax = [("207V00000X", "207V"), ("2084P|207Q", "207Q|2083"), ("2084P", "207V"), ("", "207V"), (None, "207V"), ("207V", None)]
    assert values(spark, tax, ag.taxonomy_consistent("t", "e"), "t string, e string") == [True, True, False, None, None, None]
    assert values(spark, ["Pathology - Anatomic/Pathology - Clinical", "x"], ag.taxonomy_family_pattern("x")) == ["207Z", None]


def test_schools(spark):
    cases = {
        "University of Iowa College of Medicine": "University of Iowa", "Harvard Medical School": "Harvard Medical School", "SCHOOL OF MEDICINE, UNIVERSITY OF X": "SCHOOL OF MEDICINE, UNIVERSITY OF X",
        "Feinberg School of Medicine, Northwestern University": "Northwestern University", "Tulane University School of Medicine": "Tulane University", None: None, "": "",
    }
    assert values(spark, list(cases), strip_med_suffix("x")) == list(cases.values())


def test_columns_and_sql_text_refuse_bad_input():
    with pytest.raises(ValueError):
        st.sql_npi_name(" ")
    with pytest.raises(ValueError):
        st.sql_quote_literal(3)
    assert st.sql_quote_literal(["a'b", None]) == ["'a''b'", "NULL"]
    con = duckdb.connect()
    guard = st.sql_middle_initial_guard("i", "m")
    rows = [("M", "Mary", True), ("M", "Ann", False), (None, "Ann", True), ("M", None, True), ("", "x", True)]
    for i, m, want in rows:
        assert con.execute(f"SELECT {guard} FROM (SELECT ?::VARCHAR AS i, ?::VARCHAR AS m)", [i, m]).fetchone()[0] is want


def test_literal_patterns_and_one_key(spark, sf_dir):
    """Patterns of schools are literals, compiled once; the key of a text is made once for both kinds of tokens."""
    from rosterloom import queries

    plan = lambda q: queries.QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan("schools_parts")
    assert plan("tokens_docs").count("\\p{Mn}, ") <= 1


def test_pairs_of_lines_and_people(spark, sf_dir):
    """Lines are deduped before anything of the people is joined, facts are made for people, and routes are deduped for each id."""
    from rosterloom import queries

    for q in ("middle_agreement_pairs", "surname_agreement_pairs"):
        tree = queries.QUERIES[q](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
        assert tree.index("Join") < tree.index("Aggregate")
        assert "regexp_replace" not in tree[: tree.index("Join")]
    assert "Aggregate [key" in queries.QUERIES["seven_routes_people"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
