"""The driver's entry: it imports without the training-data operators, and queries equal their SQL on the smallest tables."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from rosterloom import queries

ROOT = Path(__file__).resolve().parent.parent
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query for each kind of operator; the driver compares them all.
SOME = ["name_keys_people", "tokens_docs", "middle_agreement_pairs", "ledger_full_orders", "one_to_one_eligible_lineitem", "license_conformance_people", "seven_routes_people", "registry_json_events", "parse_person_people", "surname_agreement_pairs", "candidates_people", "schools_parts"]


def test_imports_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "rosterloom"):
        subprocess.run(["cp", "-r", ROOT / p, tmp_path], check=True)
    subprocess.run(["rm", "-rf", tmp_path / "rosterloom/llm"], check=True)
    code = "import __spark_entry__ as e; assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries()) and 'pipeline' not in e.queries() and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"disposition", "reason", "n"}


def plain(value):
    return f"{value:.9g}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    rows = lambda it: sorted(tuple(plain(v) for v in r) for r in it)
    assert rows(got.select(*order).collect()) == rows([[r[columns.index(c)] for c in order] for r in want.fetchall()])
