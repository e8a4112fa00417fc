"""Source to Bronze: extract a window, gate the schema, add metadata, write, move the watermark."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators import control
from ..sources.lake import Commit, LakeTable
from .audit import AuditLog, batch_id
from .state import StateStore

METADATA = ("ingestion_ts", "batch_id", "source_system", "pipeline_run_id", "source_table")
#: How long a table's log and its dropped files are kept.
LOG_DAYS, FILE_DAYS = 30, 7


@dataclass(frozen=True)
class BronzeSpec:
    """How a table lands: versions are added (incremental, by its version keys), or each load replaces all (snapshot)."""

    name: str
    mode: str = "snapshot"
    keys: Sequence[str] = ()
    changed: str = "updated_at"
    removed: str = "reject"

    def props(self) -> dict[str, str]:
        feed = {"changeFeed": "true"} if self.mode == "incremental" else {}
        return {"logRetention": f"{LOG_DAYS} days", "deletedFileRetention": f"{FILE_DAYS} days"} | feed


#: The tables of the platform that is imitated.
SPECS = {s.name: s for s in [
    BronzeSpec("orders", "incremental", ("order_id", "updated_at")), BronzeSpec("order_items"), BronzeSpec("order_payments"), BronzeSpec("customers"), BronzeSpec("products"), BronzeSpec("sellers")]}


@dataclass
class Loaded:
    commit: Commit
    window: control.Extraction | None
    changes: list[control.Change] = field(default_factory=list)
    watermark_moved: bool = False


def stamped(df: DataFrame, batch: str, source: str, run_id: str, table: str, now: datetime) -> DataFrame:
    """Rows with the five metadata columns."""
    return df.withColumns({"ingestion_ts": F.lit(now).cast("timestamp_ntz"), "batch_id": F.lit(batch), "source_system": F.lit(source), "pipeline_run_id": F.lit(run_id), "source_table": F.lit(table)})


def aligned(df: DataFrame, schema: StructType) -> DataFrame:
    """df with the columns of a schema cast to its types, missing ones null, and new ones behind."""
    given = {c.lower(): c for c in df.columns}
    old = [F.col(f"`{given[f.name.lower()]}`").cast(f.dataType).alias(f.name) if f.name.lower() in given else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    have = {f.name.lower() for f in schema}
    return df.select(*old, *[F.col(f"`{c}`") for c in df.columns if c.lower() not in have])


def write(spec: BronzeSpec, table: LakeTable, df: DataFrame) -> tuple[Commit, list[control.Change]]:
    """Land rows whose schema the gate lets pass.  A first load is made unique as later ones are."""
    accepted = table.schema() if table.exists() else None
    changes = list(control.enforce(control.drift(accepted, df.schema, spec.removed, METADATA)))
    if accepted is None:
        return table.create(df.dropDuplicates(list(spec.keys)) if spec.keys else df, spec.props()), changes
    table.set_props(spec.props())
    df = aligned(df, accepted)
    if spec.mode == "incremental":
        return table.insert_if_absent(df, spec.keys, evolve=True), changes
    return table.overwrite(df), changes


def extract(spec: BronzeSpec, source: DataFrame, table: LakeTable, state: StateStore, audit: AuditLog, now: datetime, lookback_minutes: int = 10, start: datetime | None = None, end: datetime | None = None, system: str = "source") -> Loaded:
    """Load a table's new rows, or a window of them; a backfill leaves the watermark where it is."""
    with audit.step("extract-bronze", spec.name, level="table") as step:
        window = None
        if spec.mode == "incremental":
            window = control.extraction_window(state.watermark(spec.name), lookback_minutes, start, end)
            moment = F.col(spec.changed)
            source = source.filter(moment >= F.lit(window.low).cast("timestamp_ntz"))
            source = source if window.high is None else source.filter(moment < F.lit(window.high).cast("timestamp_ntz"))
        commit, changes = write(spec, table, stamped(source, batch_id(spec.name, now), system, audit.run_id, spec.name, now))
        step.wrote(commit)
        step.lineage.append((f"{system}.{spec.name}", f"bronze/{spec.name}", commit.version))
        moved = False
        if window is not None and not window.backfill and commit.version is not None:
            moved = state.raise_watermark(spec.name, table.df().agg(F.max(spec.changed)).first()[0])
        return Loaded(commit, window, changes, moved)
