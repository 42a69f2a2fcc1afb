"""Each registered log query against its SQL on the smallest tables."""

import duckdb
import pytest

from logloom.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows(columns, found):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(str(round(r[i], 5)) if isinstance(r[i], float) else str(r[i]) for i in at) for r in found])


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, sql, name):
    df = catalogue.queries()[name](spark, DATA)
    r = sql.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in r.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(columns, r.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_clusters(spark):
    from logloom.operators import player

    marks = [(i * 7919 % 100_003 - 1000, ["restart", "storm", "ai", "odd"][i * 31 % 4], i) for i in range(3000)]
    want = []
    for pct, _, kind in sorted((t / 100_000.0 * 100, i, k) for t, k, i in marks if -2 <= t / 100_000.0 * 100 <= 102):
        rank = player.CLUSTER_ORDER.get(kind, 9)
        if want and pct - want[-1][0] < player.CLUSTER_GAP:
            want[-1] = (want[-1][0], want[-1][1] + 1, min(want[-1][2], (rank, kind)))
        else:
            want.append((pct, 1, (rank, kind)))
    df = spark.createDataFrame(marks, "ts_ms long, kind string, ord long")
    out = player.clusters(df, 0, 100_000)
    assert sorted(tuple(r) for r in out.collect()) == [(p, n, k[1]) for p, n, k in want]
    assert "collect_list" not in out._jdf.queryExecution().toString()  # no task gets all marks
    assert player.clusters(df.where("ord < 0"), 0, 100_000).count() == 0
