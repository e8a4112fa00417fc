"""A versioned table on Parquet files: commit log, time travel, change feed, merges and maintenance.

Each commit is a JSON file in ``_log`` that names added and removed data files
and change files.  A commit is a finished file that gets the next number, which
fails if another writer was first.  The table lies in a shared folder or on any
Hadoop file system.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.versions import latest
from .storage import Conflict, Storage

__all__ = ["Commit", "Conflict", "LakeTable", "LogStore"]
CHANGE_COLUMNS = ("_change_type", "_commit_version", "_commit_timestamp")


class LogStore:
    """Commits by number; read ones are kept, as they never change."""

    def __init__(self, storage: Storage):
        self.storage, self.known = storage, {}

    def versions(self) -> list[int]:
        names = [f.split("/")[-1] for f, _ in self.storage.files("_log")]
        return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())

    def read(self, version: int) -> dict:
        if version not in self.known:
            self.known[version] = json.loads(self.storage.read(f"_log/{version:020d}.json"))
        return self.known[version]

    def write(self, version: int, entry: dict) -> None:
        self.storage.write_new(f"_log/{version:020d}.json", json.dumps(entry))


@dataclass(frozen=True)
class Commit:
    """version is None where nothing had to be written."""

    version: int | None
    inserted: int = 0
    updated: int = 0
    deleted: int = 0


class LakeTable:
    def __init__(self, spark: SparkSession, path: str, clock=time.time):
        self.spark, self.storage, self.clock = spark, Storage(spark, path), clock
        self.path, self.log = self.storage.root, LogStore(self.storage)

    # --- state -------------------------------------------------------------
    def exists(self) -> bool:
        return bool(self.log.versions())

    def version(self) -> int | None:
        return max(self.log.versions(), default=None)

    def _upto(self, version: int | None = None) -> list[dict]:
        return [self.log.read(v) for v in self.log.versions() if version is None or v <= version]

    def _state(self, version: int | None = None) -> tuple[dict[str, dict], dict, dict]:
        """Live files, schema and properties."""
        files: dict[str, dict] = {}
        schema, props = {}, {}
        for e in self._upto(version):
            for f in e["remove"]:
                files.pop(f, None)
            files.update({f["file"]: f for f in e["add"]})
            schema, props = e.get("schema") or schema, e.get("props", props)
        return files, schema, props

    def schema(self, version: int | None = None) -> StructType:
        return StructType.fromJson(self._state(version)[1])

    def props(self) -> dict[str, str]:
        return self._state()[2]

    def _read(self, files: Sequence[str], schema: StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.storage.path(f) for f in files])

    def df(self, version: int | None = None, timestamp: float | None = None) -> DataFrame:
        """Rows now, at a version, or as of a time (the last commit not after it)."""
        if version is not None and timestamp is not None:
            raise ValueError("give a version or a timestamp")
        if timestamp is not None:
            at = [e["version"] for e in self._upto() if e["ts"] <= timestamp]
            if not at:
                raise ValueError("the table is younger")
            version = at[-1]
        if version is not None and version not in self.log.versions():
            raise ValueError(f"no version {version}")
        files, schema, _ = self._state(version)
        return self._read(list(files), StructType.fromJson(schema))

    def history(self, limit: int | None = None) -> DataFrame:
        rows = [(e["version"], e["ts"], e["op"], {k: str(v) for k, v in e["metrics"].items()}) for e in reversed(self._upto())]
        return self.spark.createDataFrame(rows[:limit], "version long, ts double, operation string, metrics map<string,string>")

    def write_counts(self, before: int | None) -> dict[str, int]:
        """Rows inserted, updated and deleted since a version; no new version, no rows."""
        fresh = self.history().filter(F.col("version") > (-1 if before is None else before))
        kinds = ("inserted", "updated", "deleted")
        row = fresh.agg(*[F.coalesce(F.sum(F.try_element_at("metrics", F.lit(k)).cast("long")), F.lit(0)).alias(k) for k in kinds]).first()
        return row.asDict()

    def detail(self) -> dict:
        files = self._state()[0].values()
        return {"files": len(files), "bytes": sum(f["bytes"] for f in files), "rows": sum(f["rows"] for f in files)}

    # --- writing -----------------------------------------------------------
    def _files(self, df: DataFrame, rows_per_file: int = 1_000_000) -> list[dict]:
        """Write rows as new data files; executors count what they hold, whatever the file system."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(self.storage.path(name))
        got = self.spark.read.schema(df.schema).parquet(self.storage.path(name)).groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("s")).agg(F.count("*").alias("n"))
        return sorted(({"file": f"{name}/{r['f']}", "rows": r["n"], "bytes": r["s"]} for r in got.collect()), key=lambda f: f["file"])

    def _commit(self, op: str, base: int | None, add=(), remove=(), change=(), schema=None, props=None, metrics=None, data_change=True) -> int:
        version = 0 if base is None else base + 1
        self.log.write(version, {"version": version, "ts": self.clock(), "op": op, "add": list(add), "remove": list(remove), "change": list(change), "schema": schema, "props": props if props is not None else (self._state()[2] if base is not None else {}), "metrics": metrics or {}, "dataChange": data_change})
        return version

    def _evolved(self, df: DataFrame, evolve: bool) -> tuple[DataFrame, StructType]:
        """df in the table's columns (cast, missing ones null) and the schema afterwards."""
        have = self.schema()
        known = {f.name.lower(): f for f in have}
        more = [f for f in df.schema if f.name.lower() not in known]
        if more and not evolve:
            raise ValueError(f"columns {[f.name for f in more]} are not in the table")
        given = {c.lower(): c for c in df.columns}
        cols = [F.col(given[f.name.lower()]).cast(f.dataType).alias(f.name) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in have]
        return df.select(*cols, *[f.name for f in more]), StructType([*have.fields, *more])

    def create(self, df: DataFrame, props: dict[str, str] | None = None) -> Commit:
        if self.exists():
            raise ValueError("the table exists")
        add = self._files(df)
        n = sum(f["rows"] for f in add)
        return Commit(self._commit("CREATE", None, add, schema=df.schema.jsonValue(), props={}, metrics={"inserted": n}), n) if not props else self._created(df, add, n, props)

    def _created(self, df, add, n, props) -> Commit:
        v = self._commit("CREATE", None, add, schema=df.schema.jsonValue(), props={}, metrics={"inserted": n})
        self.set_props(props)
        return Commit(v, n)

    def set_props(self, wanted: dict[str, str]) -> list[str]:
        """Keys that differed; no commit without any."""
        now = self.props()
        keys = sorted(k for k, v in wanted.items() if now.get(k) != v)
        if keys:
            self._commit("SET PROPERTIES", self.version(), props={**now, **wanted}, data_change=False)
        return keys

    def overwrite(self, df: DataFrame, evolve: bool = False) -> Commit:
        """Replace all rows; with ``evolve`` the schema too, else it is kept and merged."""
        base = self.version()
        if base is None:
            return self.create(df)
        schema = df.schema
        if not evolve:
            df, schema = self._evolved(df, True)
        old = self._state()[0]
        add = self._files(df)
        n = sum(f["rows"] for f in add)
        gone = sum(f["rows"] for f in old.values())
        return Commit(self._commit("OVERWRITE", base, add, old, schema=schema.jsonValue(), metrics={"inserted": n, "deleted": gone}), n, 0, gone)

    def append(self, df: DataFrame, evolve: bool = False) -> Commit:
        base = self.version()
        df, schema = self._evolved(df, evolve)
        add = self._files(df)
        n = sum(f["rows"] for f in add)
        return Commit(self._commit("APPEND", base, add, schema=schema.jsonValue(), metrics={"inserted": n}), n) if n else Commit(None)

    def insert_if_absent(self, df: DataFrame, keys: Sequence[str], evolve: bool = False) -> Commit:
        """Insert rows whose keys (null equal to null) are not there; the batch is made unique first."""
        held = self.df().select(*keys).alias("t")
        batch = df.dropDuplicates(list(keys)).alias("b")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"b.{k}").eqNullSafe(F.col(f"t.{k}"))
        return self.append(batch.join(held, on, "left_anti"), evolve)

    def upsert_newer(self, df: DataFrame, keys: Sequence[str], version: str, evolve: bool = False) -> Commit:
        """Insert new keys, replace rows whose version is older; equal and older batch rows do nothing.

        Of several batch rows with one key the newest counts.  Only files that
        hold a replaced row are written again.
        """
        base = self.version()
        batch, schema = self._evolved(latest(df, keys, [version]), evolve)
        target = self.df()
        held = target.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(version).alias("__held"), F.col("_metadata.file_name").alias("__file")) if self._state()[0] else None
        if held is None:
            return self.append(batch, evolve)
        on = F.lit(True)
        for k in keys:
            on = on & batch[k].eqNullSafe(F.col(f"__{k}"))
        met = batch.join(held, on, "left")
        act = met.filter(F.col("__file").isNull() | (F.col(version) > F.col("__held"))).drop("__held", *[f"__{k}" for k in keys])
        name = f"merge-{uuid.uuid4().hex}"
        act.write.parquet(self.storage.path(name))
        staged = self.spark.read.schema(act.schema).parquet(self.storage.path(name))
        counts = staged.agg(F.count_if(F.col("__file").isNull()), F.count_if(F.col("__file").isNotNull())).first()
        if not counts[0] and not counts[1]:
            return Commit(None)
        # files holding replaced rows; as many as the table has at most
        touched = {r[0] for r in staged.filter("__file is not null").select("__file").distinct().collect()}
        hit = self._named(touched)
        fresh = staged.drop("__file")
        old = self._read(hit, schema)
        b = fresh.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & old[k].eqNullSafe(F.col(f"__{k}"))
        keep = old.join(b, same, "left_anti")
        add = self._files(keep.unionByName(fresh.select(*schema.names)))
        change = self._files(old.join(b, same, "left_semi").withColumn("_change_type", F.lit("update_preimage")).unionByName(
            staged.withColumn("_change_type", F.when(F.col("__file").isNull(), "insert").otherwise("update_postimage")).drop("__file").select(*schema.names, "_change_type")))
        v = self._commit("MERGE", base, add, hit, change, schema.jsonValue(), metrics={"inserted": counts[0], "updated": counts[1]})
        return Commit(v, counts[0], counts[1])

    def delete(self, condition: Column | str) -> Commit:
        """Delete rows that meet a condition (null does not); only files with such rows are written again."""
        base, schema = self.version(), self.schema()
        hit = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
        met = self.df().filter(hit) if self._state()[0] else None
        touched = {r[0] for r in met.select("_metadata.file_name").distinct().collect()} if met is not None else set()
        if not touched:
            return Commit(None)
        files = self._named(touched)
        rows = self._read(files, schema)
        change = self._files(rows.filter(hit).withColumn("_change_type", F.lit("delete")))
        add = self._files(rows.filter(~hit))
        n = sum(f["rows"] for f in change)
        return Commit(self._commit("DELETE", base, add, files, change, schema.jsonValue(), metrics={"deleted": n}), 0, 0, n)

    def _named(self, names: set[str]) -> list[str]:
        """Live files by their own names, which no two share."""
        return [f for f in self._state()[0] if f.rpartition("/")[2] in names]

    def restore(self, version: int) -> Commit:
        files, schema, _ = self._state(version)
        now = self._state()[0]
        add, remove = [f for k, f in files.items() if k not in now], [k for k in now if k not in files]
        v = self._commit("RESTORE", self.version(), add, remove, schema=schema, metrics={"restored": version})
        return Commit(v, sum(f["rows"] for f in add), 0, sum(now[k]["rows"] for k in remove))

    def optimize(self, small_bytes: int = 32 << 20, rows_per_file: int = 1_000_000) -> Commit:
        """Write small files together; rows stay, the change feed shows nothing."""
        live = self._state()[0]
        small = [f for f, m in live.items() if m["bytes"] < small_bytes]
        if len(small) < 2:
            return Commit(None)
        rows = sum(live[f]["rows"] for f in small)
        add = self._files(self._read(small, self.schema()).coalesce(max(1, -(-rows // rows_per_file))), rows_per_file)
        return Commit(self._commit("OPTIMIZE", self.version(), add, small, metrics={"removed": len(small), "added": len(add)}, data_change=False))

    def vacuum(self, keep_seconds: float = 7 * 86400, dry_run: bool = True) -> list[str]:
        """Data files that no version within the retention needs; deleted unless it is a dry run."""
        edge = self.clock() - keep_seconds
        needed = set(self._state()[0])
        for e in self._upto():
            if e["ts"] >= edge:
                needed |= set(e["remove"]) | {f["file"] for f in [*e["add"], *e["change"]]}
        out = [f for f, changed in self.storage.files() if f.startswith(("data-", "merge-")) and f.endswith(".parquet") and f not in needed and changed <= edge]
        if not dry_run:
            for f in out:
                self.storage.delete(f)
        return out

    # --- change feed -------------------------------------------------------
    def feed_since(self) -> int | None:
        """First version since which the feed has been on without a break."""
        since = None
        for e in self._upto():
            on = e.get("props", {}).get("changeFeed") == "true"
            since = (e["version"] if since is None else since) if on else None
        return since

    def changes(self, start: int, end: int | None = None) -> DataFrame:
        """Row changes of versions start to end, both included, with type, version and time."""
        since = self.feed_since()
        if since is None or start < since:
            raise ValueError("no change feed for that version")
        schema = self.schema(end)
        out = self.spark.createDataFrame([], schema).select("*", F.lit("").alias("_change_type"), F.lit(0).cast("long").alias("_commit_version"), F.lit(0.0).alias("_commit_timestamp"))
        for e in self._upto(end):
            if e["version"] < start or not e["dataChange"]:
                continue
            if e["change"]:
                rows = self._read([f["file"] for f in e["change"]], StructType([*schema.fields, *StructType.fromDDL("_change_type string").fields]))
            else:
                rows = self._read([f["file"] for f in e["add"]], schema).withColumn("_change_type", F.lit("insert"))
                if e["remove"]:
                    rows = rows.unionByName(self._read(e["remove"], schema).withColumn("_change_type", F.lit("delete")))
            out = out.unionByName(rows.withColumn("_commit_version", F.lit(e["version"]).cast("long")).withColumn("_commit_timestamp", F.lit(float(e["ts"]))))
        return out
