import duckdb
import pytest

from quarry.plans import batches, catalog, conversations, conversion, evaluation, plugins, samples, texts, training  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(spark, sql, name):
    ours, theirs = catalog.QUERIES[name](spark, DATA).toPandas(), sql.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and len(ours) == len(theirs)
    cols = sorted(ours.columns)
    a, b = (x[cols].sort_values(cols).reset_index(drop=True) for x in (ours, theirs))
    for c in cols:
        if a[c].dtype.kind in "fi":
            assert ((a[c].astype(float) - b[c].astype(float)).abs().fillna(0) < 2e-6).all(), c
        else:
            assert a[c].equals(b[c].astype(a[c].dtype)), c
