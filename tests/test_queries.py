import os

import duckdb
import pytest

from strata.plans.catalog import ORACLES, QUERIES, TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.execute(f"create view {t} as select * from '{p}/*.parquet'" if os.path.isdir(p) else f"create view {t} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sql, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    done = sql.execute(ORACLES[name])
    names = [x[0] for x in done.description]
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in df.columns]
    assert sorted(map(repr, got)) == sorted(repr(tuple(r[i] for i in at)) for r in done.fetchall())


def test_flow_paths_cover_the_whole_log(spark, tmp_path):
    rows = [(1, 7, "view"), (2, 7, "error"), (20, 8, "click"), (21, 8, "error"), (39, 7, "click")]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = {tuple(r) for r in QUERIES["flow_paths"](spark, str(tmp_path)).collect()}
    assert got == {(7, 3, 1, 2, "view > error > click"), (8, 2, 1, 21, "click > error")}


def test_last_batches_bring_the_whole_table(spark, sql):
    assert QUERIES["bronze_insert_only_merge"](spark, SF).count() == sql.execute("select count(*) from events").fetchone()[0]
    newest = QUERIES["scd2_snapshot"](spark, SF).filter("valid_to is null").select("user_id", "valid_from").collect()
    assert sorted(map(tuple, newest)) == sorted(sql.execute("select user_id, max(ts) from events group by 1").fetchall())


def test_lake_tables_lie_in_the_shared_folder(tmp_path):
    from types import SimpleNamespace

    from strata.plans import catalog

    for named in (f"{tmp_path}/a", f"file:{tmp_path}/b", f"file://{tmp_path}/c"):
        session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default, named=named: named))
        assert catalog._lake(session, "bronze").path.startswith(str(tmp_path))
