import json
import logging
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from strata.models import marts  # noqa: F401
from strata.models.registry import MODELS, build, order
from strata.operators import rules
from strata.operators.control import SchemaRejected
from strata.pipeline import audit, bronze, checks, silver, tools
from strata.pipeline.state import StateStore
from strata.sources import generated
from strata.sources.lake import LakeTable
from strata.sources.storage import Conflict

DDL = "id string, state string, made timestamp_ntz, changed timestamp_ntz"


def at(day, hour=0):
    return datetime(2025, 3, day, hour)


@pytest.fixture
def lake(spark, tmp_path):
    class Lake:
        now = [1000.0]
        state = StateStore(spark, f"{tmp_path}/state", "run-1", lambda: Lake.now[0])
        audit = audit.AuditLog(spark, f"{tmp_path}/audit", "run-1", lambda: Lake.now[0])
        spec = bronze.BronzeSpec("jobs", "incremental", ("id", "changed"), "changed")
        silver_spec = silver.SilverSpec("jobs", ("id",), "changed", (*rules.required("id"), rules.one_of("state", ["open", "done"]), rules.that("made_first", "made <= changed")), True)
        bronze, silver, quarantine = (LakeTable(spark, f"{tmp_path}/{n}/jobs") for n in ("bronze", "silver", "quarantine"))

        def land(self, rows, ddl=DDL, now=at(20), **window):
            return bronze.extract(self.spec, spark.createDataFrame(rows, ddl), self.bronze, self.state, self.audit, now, **window)

        def merge(self, force=False):
            return silver.process(self.silver_spec, self.bronze, self.silver, self.quarantine, self.state, force)

        def held(self):
            return {r.id: (r.state, r.changed) for r in self.silver.df().collect()}

    return Lake()


def test_state_store(spark, tmp_path):
    s = StateStore(spark, str(tmp_path / "s"), "r1", lambda: 5.0)
    assert s.watermark("t") is None and s.raise_watermark("t", None) is False
    assert s.raise_watermark("t", at(3)) and not s.raise_watermark("t", at(3)) and not s.raise_watermark("t", at(2)) and s.raise_watermark("t", at(4, 1))
    assert s.watermark("t") == at(4, 1)
    assert s.set_checkpoint("x/y", 3, "full") and not s.set_checkpoint("x/y", 3, "skip") and s.set_checkpoint("x/y", 4, "incremental") and s.checkpoint("x/y") == 4
    with pytest.raises(Conflict):
        s.put("checkpoint", "x/y", {"version": 9}, 1)
    rows = [(r.kind, r.name, r.seq, r.run_id) for r in s.history().orderBy("kind", "name", "seq").collect()]
    assert rows == [("checkpoint", "x/y", 1, "r1"), ("checkpoint", "x/y", 2, "r1"), ("watermark", "t", 1, "r1"), ("watermark", "t", 2, "r1")]
    ran = []
    steps = [(n, lambda n=n: ran.append(n)) for n in ("002_b", "001_a")]
    assert s.migrate(steps) == ["001_a", "002_b"] == ran and s.migrate([*steps, ("003_c", lambda: ran.append("c"))]) == ["003_c"]
    with pytest.raises(Conflict):
        s.migrate([("004_d", lambda: s.migrate([]))])
    assert s.migrate([]) == []


def test_extraction_moves_the_watermark_and_adds_versions_once(lake):
    first = lake.land([("a", "open", at(1), at(1)), ("a", "open", at(1), at(1)), ("b", "open", at(1), at(2))])
    assert first.commit.inserted == 2 and first.watermark_moved and lake.state.watermark("jobs") == at(2)
    assert lake.bronze.props() == {"logRetention": "30 days", "deletedFileRetention": "7 days", "changeFeed": "true"}
    assert {*bronze.METADATA} <= {*lake.bronze.df().columns}
    again = lake.land([("a", "open", at(1), at(1)), ("b", "open", at(1), at(2)), ("b", "done", at(1), at(2, 5))])
    assert again.window.low == datetime(2025, 3, 1, 23, 50) and again.commit.inserted == 1
    assert lake.land([("b", "done", at(1), at(2, 5))]).commit.version is None
    old = lake.land([("c", "open", at(1), at(1, 3)), ("d", "open", at(1), at(9))], start=at(1), end=at(2))
    assert old.commit.inserted == 1 and not old.watermark_moved and lake.state.watermark("jobs") == at(2, 5)
    read = {(r.status, r.table_name) for r in audit.latest_events(lake.audit.events()).collect()}
    assert read == {("SUCCESS", "jobs")} and LakeTable(lake.bronze.spark, f"{lake.audit.path}/lineage").df().count() == 4


def test_extraction_gates_the_schema(lake):
    lake.land([("a", "open", at(1), at(1))])
    wide = lake.land([("b", "open", at(1), at(2), 7)], DDL + ", level int")
    assert [(c.column, c.action) for c in wide.changes] == [("level", "evolve")] and lake.bronze.df().filter("level is null").count() == 1
    before = lake.bronze.version()
    for rows, ddl in (([("c", "open", at(3))], "id string, state string, changed timestamp_ntz"), ([("c", 5, at(1), at(3))], "id string, state int, made timestamp_ntz, changed timestamp_ntz")):
        with pytest.raises(SchemaRejected):
            lake.land(rows, ddl)
    assert lake.bronze.version() == before
    assert [r.status for r in audit.latest_events(lake.audit.events()).orderBy("seq").collect()] == ["SUCCESS", "SUCCESS", "FAILED", "FAILED"]


def test_silver_follows_bronze(lake):
    lake.land([("a", "open", at(1), at(3)), ("b", "open", at(1), at(9)), ("c", "lost", at(1), at(2))])
    m = lake.merge()
    assert (m.mode, m.read, m.inserted, m.updated, m.rejected) == ("full", 3, 2, 0, 1)
    version = lake.silver.version()
    assert lake.merge().mode == "skip" and lake.silver.version() == version
    # newer, late, new, twice, rejected after a valid one, and broken in two ways
    lake.land([("a", "done", at(1), at(5)), ("b", "open", at(1), at(4)), ("d", "open", at(2), at(6)), ("d", "done", at(2), at(7)), ("b", "gone", at(1), at(10)), (None, "x", at(9), at(8))], start=at(1))
    m = lake.merge()
    assert (m.mode, m.read, m.inserted, m.updated, m.rejected, m.duplicates, m.late, m.superseded_by_invalid) == ("incremental", 6, 1, 1, 2, 1, 1, 2 - 1)
    want = {"a": ("done", at(5)), "b": ("open", at(9)), "d": ("done", at(7))}
    assert lake.held() == want
    log = {(r.id, r.reason) for r in lake.quarantine.df().collect()}
    assert log == {("c", "accepted:state"), ("b", "accepted:state"), (None, "not_null:id, accepted:state, made_first")}
    # making all of it anew changes nothing
    m = lake.merge(force=True)
    assert (m.mode, m.read, m.inserted, m.updated) == ("full", 9, 0, 0) and lake.held() == want and lake.quarantine.df().count() == 3
    # rows that Bronze loses stay
    assert lake.bronze.delete("id = 'd'").deleted == 2
    m = lake.merge()
    assert (m.mode, m.read) == ("incremental", 0) and lake.held() == want


def test_silver_falls_back_when_the_feed_cannot_be_read(lake, monkeypatch):
    lake.land([("a", "open", at(1), at(3))])
    lake.merge()
    lake.land([("b", "open", at(1), at(4))])
    monkeypatch.setattr(lake.bronze, "changes", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    m = lake.merge()
    assert m.mode == "full" and "gone" in m.why and m.inserted == 1 and lake.state.checkpoint("silver/jobs") == lake.bronze.version()


def test_snapshots_are_made_anew(spark, lake, tmp_path):
    spec = bronze.BronzeSpec("parts", removed="fill_null")
    t, s, q = (LakeTable(spark, f"{tmp_path}/{n}/parts") for n in ("bronze", "silver", "quarantine"))
    for rows, ddl in (([(1, "x"), (2, None)], "k int, name string"), ([(1, "y"), (3, "z")], "k int, name string"), ([(5,)], "k int")):
        bronze.extract(spec, spark.createDataFrame(rows, ddl), t, lake.state, lake.audit, at(5))
        m = silver.process(silver.SilverSpec("parts", ("k",), "ingestion_ts", tuple(rules.required("name"))), t, s, q, lake.state)
    assert "changeFeed" not in t.props() and t.df().count() == 1 and (m.read, m.inserted, m.rejected) == (1, 0, 1) and q.df().first().reason == "not_null:name"


def test_audit_never_stops_the_work(spark):
    def broken(*a):
        raise OSError("no disk")

    log = audit.AuditLog(spark, "", "r", append=broken)
    with log.step("works") as step:
        step.read = 3
    with pytest.raises(KeyError), log.step("fails"):
        raise KeyError("body")
    told = []
    log = audit.AuditLog(spark, "", "r", lambda: 7.0, lambda name, rows, schema: told.append((name, *rows[0][5:7], rows[0][-1])))
    with pytest.raises(ValueError), log.step("fails", "t"):
        raise ValueError("x" * 9000)
    assert [t[2] for t in told] == ["RUNNING", "FAILED"] and len(told[1][3]) == audit.MOST_ERROR
    assert audit.batch_id("t", at(1)).startswith("t-20250301T000000-") and audit.batch_id("t", at(1)) != audit.batch_id("t", at(1))
    line = json.loads(audit.JsonLog("r9", "s").format(logging.LogRecord("l", 20, "f", 1, "hello %s", ("you",), None)))
    assert line == {"level": "INFO", "logger": "l", "message": "hello you", "run_id": "r9", "step": "s"}


def test_runs_and_abandoned_steps(spark, lake):
    with lake.audit.step("daily", level="flow"):
        with pytest.raises(RuntimeError), lake.audit.step("land"):
            lake.now[0] += 60
            raise RuntimeError
        with lake.audit.step("land", retry=1):
            lake.now[0] += 30
        with lake.audit.step("load", "t", level="table") as step:
            step.inserted, step.rejected = 5, 2
    running = lake.audit.step("model")
    running.__enter__()
    assert lake.audit.abandon(3600) == 0
    lake.now[0] += 7200
    assert lake.audit.abandon(3600) == 1 and lake.audit.abandon(3600) == 0
    steps = audit.latest_events(lake.audit.events())
    run = audit.flow_runs(steps).first()
    assert (run.status, run.seconds, run.task_attempts, run.failed_attempts, run.retried_attempts, run.first_failed_task, run.steps_succeeded, run.rows_inserted, run.rows_rejected) == ("SUCCESS", 90.0, 3, 2, 1, "land", "land", 5, 2)
    stats = {r.task_name: r for r in audit.task_stats(steps).collect()}
    assert (stats["land"].attempts, stats["land"].success_rate, stats["land"].median_seconds) == (2, 50.0, 30.0) and stats["model"].last_status == "ABANDONED"
    assert audit.run_stats(audit.flow_runs(steps)).first().asDict() == {"runs": 1, "success_pct": 100.0, "median_minutes": 1.5, "last_status": "SUCCESS"}
    assert {(r.task_name, r.minutes) for r in audit.recent_durations(steps).collect()} >= {("land", 1.0), ("land", 0.5)}


def test_checks_and_scorecard(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, "b", 2.0), (None, "zz", None)], "k int, s string, x double")
    one = lambda v: spark.createDataFrame([(v,)], "v double")
    made = [checks.breaking("unique_k", checks.unique(df, "k")), checks.breaking("source_not_null_k", checks.not_null(df, "k"), False), checks.breaking("accepted_values_s", checks.accepted_values(df, "s", ["a", "b", "zz"])),
            checks.breaking("relationships_k", checks.relationships(df, "k", spark.createDataFrame([(2,)], "id int"), "id")), checks.breaking("non_negative_x", checks.non_negative(df, "x")), checks.breaking("unique_combination_k_s", checks.unique(df, "k", "s")),
            checks.breaking("own", df.filter("false")), checks.difference("cents", ("a", one(2.0)), ("b", one(2.009)), True, checks.TOLERANCE), checks.difference("rows", ("a", one(2.0)), ("b", one(None)), False)]
    got = {r.check_name: (r.category, r.status, r.rows_failed) for r in checks.record(made).collect()}
    assert got == {"unique_k": ("uniqueness", "FAIL", 1), "source_not_null_k": ("completeness", "WARN", 1), "accepted_values_s": ("validity", "PASS", 0), "relationships_k": ("referential_integrity", "FAIL", 2),
                   "non_negative_x": ("validity", "FAIL", 1), "unique_combination_k_s": ("uniqueness", "PASS", 0), "own": ("business_rule", "PASS", 0), "cents": ("reconciliation", "PASS", 0), "rows": ("reconciliation", "WARN", 2)}
    log = spark.createDataFrame([(1, "r", "a", "x", "FAIL"), (2, "r", "a", "x", "PASS"), (3, "r", "b", "x", "WARN"), (4, "r", "c", "y", "FAIL"), (5, "q", "a", "x", "PASS")], "id long, run_id string, check_name string, category string, status string")
    cards = {r.run_id: tuple(r)[1:] for r in checks.scorecard(log).collect()}
    assert cards == {"r": (3, 1, 1, 1, 33.3, 50.0), "q": (1, 1, 0, 0, 100.0, 100.0)}
    text = json.dumps({"results": [{"unique_id": "model.p.m", "status": "success"}, {"unique_id": "test.p.not_null_a_b.1f", "status": "error", "failures": None, "message": "no"}, {"unique_id": "test.p.odd", "status": "warn", "failures": 4}]})
    assert [tuple(r) for r in checks.test_results(spark, text).collect()] == [("not_null_a_b", "completeness", "FAIL", 0, "no"), ("odd", "business_rule", "WARN", 4, "")]
    assert [r.status for r in checks.source_freshness(spark, json.dumps({"results": [{"unique_id": "source.p.s.t", "status": "warn", "max_loaded_at": "x"}]})).collect()] == ["WARN"]


def test_models_are_built_in_order(spark, tmp_path):
    names = order(["agg_product_sales"])
    assert names.index("fact_orders") > names.index("dim_customer") and names[-1] == "agg_product_sales" and "agg_daily_sales" not in names
    assert set(order()) == set(MODELS)
    sources = {n: spark.read.parquet(f"/root/testdata/sf0.001/{n}.parquet") for n in ("orders", "lineitem", "part", "customer")}
    frames = build(sources, ["aggregates_disagree", "retention_matrix"], str(tmp_path))
    assert frames["aggregates_disagree"].isEmpty() and (tmp_path / "fact_orders").exists()
    # each order has the version of its customer that held when it was placed
    wrong = frames["fact_orders"].join(frames["dim_customer"], "customer_key").filter("purchased_at < valid_from or purchased_at >= valid_to")
    assert wrong.isEmpty() and frames["fact_orders"].filter("customer_key is null").isEmpty() and frames["fact_orders"].count() == sources["lineitem"].count()
    with pytest.raises(KeyError):
        build({"orders": sources["orders"]}, ["fact_orders"])


def test_tools(spark, tmp_path):
    t = LakeTable(spark, f"{tmp_path}/lake/bronze/things")
    t.create(spark.range(4).toDF("k"), {"changeFeed": "true"})
    t.append(spark.range(4, 6).toDF("k"))
    t.delete("k = 0")
    LakeTable(spark, f"{tmp_path}/lake/silver/_quarantine/things").create(spark.range(1).toDF("k"))
    assert tools.tables(spark, f"{tmp_path}/lake") == ["bronze/things", "silver/_quarantine/things"]
    assert sorted((r.k, r.change) for r in tools.key_changes(t, "k", 0, 3).collect()) == [(0, "missing"), (4, "added"), (5, "added")]
    assert "| 3 | delete | 1 |" in tools.main([f"{tmp_path}/lake", "bronze/things", "changes", "--since", "2"], spark)
    assert "CREATE" in tools.main([f"{tmp_path}/lake", "bronze/things", "history"], spark) and tools.main([f"{tmp_path}/lake", "bronze/things", "as-of", "--version", "0"], spark).count("\n") == 5
    assert tools.maintain(t, dry_run=True)["compacted"] is False
    assert [tuple(r) for r in tools.columns(spark.range(1)).collect()] == [("id", "bigint", 0)]
    sizes = tools.partition_sizes(spark.range(0, 90, 1, 3)).first()
    assert (sizes.total, sizes.largest) == (90, 30)
    ticks = iter(range(100))
    assert tools.timed(lambda: next(ticks), 3, 1, lambda: float(next(ticks))) == {"min": 2.0, "median": 2.0, "max": 2.0}
    with tools.conf(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"
    ways = tools.compare_skew_joins(spark, *generated.skewed(spark, 5000, 20), "k", 4)
    assert [w["way"] for w in ways] == ["plain", "broadcast", "salted", "adaptive"] and {w["rows"] for w in ways} == {5000}
    page = tools.export({"a": spark.createDataFrame([(1, "x")], "n int, s string"), "b": spark.range(3)}, f"{tmp_path}/out")
    assert "## a\n\n1 rows" in page and {k: v.count() for k, v in tools.load_exports(spark, f"{tmp_path}/out").items()} == {"a": 1, "b": 3}


def test_datasets_of_operations(spark, lake):
    with lake.audit.step("daily", level="flow"), lake.audit.step("land"), lake.audit.step("load", "t", level="table"):
        pass
    log = spark.createDataFrame([(1, "run-1", "a", "x", "PASS", 0, ""), (2, "run-1", "b", "y", "FAIL", 3, "")], "id long, run_id string, check_name string, category string, status string, rows_failed long, detail string")
    rejected = spark.createDataFrame([(1.0, "run-1", "t", "rule", 4, "k=1")], "at double, run_id string, table_name string, rule string, rows long, sample string")
    drift = spark.createDataFrame([(1.0, "t", "c", "added")], "at double, table_name string, column string, kind string")
    given = {"steps": audit.latest_events(lake.audit.events()), "results": log, "rejected": rejected, "drift": drift}
    got = {name: make(given).count() for name, make in tools.OPERATIONS.items()}
    assert got == {"flow_runs": 1, "task_runs": 1, "task_stats": 1, "table_loads_latest": 1, "dq_scorecard": 1, "dq_by_category_latest": 2, "dq_checks_latest": 2, "rejected_records": 1, "schema_changes": 1}
    assert tools.OPERATIONS["dq_checks_latest"](given).first().status == "FAIL"
    assert len(tools.MODELS) + len(tools.OPERATIONS) == 16


def test_whole_platform_on_a_made_up_shop(spark, lake, tmp_path):
    """Twice the same load changes nothing; a changed source is followed."""
    shop, specs = generated.shop(spark, 120), silver.table_specs()
    tables = {n: [LakeTable(spark, f"{tmp_path}/{layer}/{n}") for layer in ("bronze", "silver", "silver/_quarantine")] for n in ("orders", "customers")}

    def run(source, now):
        out = {}
        for n, (b, s, q) in tables.items():
            bronze.extract(bronze.SPECS[n], source[n], b, lake.state, lake.audit, now)
            out[n] = silver.process(specs[n], b, s, q, lake.state)
        return out

    first = run(shop, at(1))
    assert first["orders"].mode == "full" and first["orders"].inserted == 120 and first["orders"].rejected == 0
    version = tables["orders"][1].version()
    assert run(shop, at(2))["orders"].mode == "skip" and tables["orders"][1].version() == version
    later = generated.changed_shop(shop, F.lit(datetime(2026, 1, 1)).cast("timestamp_ntz"), 2, 3)
    done = run(later, at(3))["orders"]
    assert (done.mode, done.read, done.updated) == ("incremental", 2, 2)
    assert tables["customers"][1].df().filter("customer_city like 'new %'").count() == 3
