"""Every registered query against its SQL on the smallest tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

from millrace.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(names, columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: [str(x) for x in r])


@pytest.fixture(scope="session")
def oracle(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{small}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, small, oracle, name):
    df = QUERIES[name](spark, small)
    got = rows_of(name, df.columns, [tuple(r) for r in df.collect()])
    cursor = oracle.execute(ORACLE_SQL[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows_of(name, columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(spark, small, name):
    df = QUERIES[name](spark, small)
    assert df.columns and df.count() >= 0


def test_no_plan_is_a_cross_join(spark, small):
    """Neither a cartesian product nor a nested loop but where one side is a single row, or a stated set of short texts."""
    one_row = {"bootstrap_paired_composite", "label_kappa", "error_taxonomy", "status_frequency", "maybe_missing_table", "bootstrap_paired_groups"}
    stated = {"benchmark_containment", "leakage_reasons"}
    for name, f in QUERIES.items():
        plan = f(spark, small)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan, name
        assert name in one_row | stated or "NestedLoop" not in plan, name


def test_entry_works_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'millrace.llm' or name.startswith('millrace.llm.') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(f'No module named {name!r}', name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert len(e.queries()) > 60 and not any(n.startswith('op1') for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_is_not_empty(spark, small):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
