"""Every query of the library against its SQL on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from loomgraph.plans import queries, registry  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return v.isoformat()[:19] if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([str(tuple(plain(r[c]) for c in columns)) for r in df.collect()])
    rel = duck.sql(registry.ORACLE_SQL[name])
    names = rel.columns
    assert sorted(names) == columns
    assert got == sorted(str(tuple(plain(r[names.index(c)]) for c in columns)) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_does_not_need_the_corpus_operators():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['corpus_pipeline'] = None; sys.modules['loomgraph.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1') for k in q)"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
