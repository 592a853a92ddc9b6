"""Every query with an oracle gives the oracle's rows; every other query gives rows."""

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].copy()
    for c in pdf.columns:
        if str(pdf[c].dtype).startswith("datetime"):
            pdf[c] = pdf[c].astype("datetime64[us]")
    text = pdf.astype(str).replace({"<NA>": "None", "nan": "None", "NaT": "None"})
    return sorted(map(tuple, text.values.tolist()))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_oracle(spark, duck, sf_dir, name):
    mine = QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(ORACLE[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_gives_rows(spark, name):
    # the smallest tables have no stamp with all grid points, so models have no rows there
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns[0] == "model_name" and out.count() == 5


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
