"""Control state: watermarks, checkpoints, applied migrations, all with their history.

A value is a file with the next number of its series; as only one writer gets a
number, setting a value is a compare-and-set, and the older files are the
history.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from ..sources.storage import Conflict, Storage

HISTORY = "kind string, name string, seq long, at double, run_id string, value string"


class StateStore:
    def __init__(self, spark: SparkSession, root: str, run_id: str | None = None, clock: Callable[[], float] = time.time):
        self.spark, self.storage, self.run_id, self.clock = spark, Storage(spark, root), run_id, clock

    def _series(self, kind: str, name: str) -> list[str]:
        return [f for f, _ in self.storage.files(f"{kind}/{name}") if f.endswith(".json")]

    def get(self, kind: str, name: str) -> tuple[int, dict | None]:
        """The number and the value that hold now; (0, None) without any."""
        files = self._series(kind, name)
        return (len(files), json.loads(self.storage.read(files[-1]))["value"]) if files else (0, None)

    def put(self, kind: str, name: str, value: dict, seq: int) -> None:
        """Set a value that was decided on when ``seq`` held; Conflict if another one was set since."""
        entry = {"at": self.clock(), "run_id": self.run_id, "value": value}
        self.storage.write_new(f"{kind}/{name}/{seq + 1:012d}.json", json.dumps(entry))

    def history(self) -> DataFrame:
        rows = []
        for f, _ in self.storage.files():
            if f.endswith(".json"):
                kind, *name, seq = f[: -len(".json")].split("/")
                e = json.loads(self.storage.read(f))
                rows.append((kind, "/".join(name), int(seq), e["at"], e["run_id"], json.dumps(e["value"])))
        return self.spark.createDataFrame(rows, HISTORY)

    # --- watermarks: they only rise ------------------------------------------
    def watermark(self, table: str) -> datetime | None:
        value = self.get("watermark", table)[1]
        return datetime.fromisoformat(value["upto"]) if value else None

    def raise_watermark(self, table: str, upto: datetime | None) -> bool:
        """Whether the watermark moved; a concurrent writer that went further wins."""
        while upto is not None:
            seq, value = self.get("watermark", table)
            if value and datetime.fromisoformat(value["upto"]) >= upto:
                return False
            try:
                self.put("watermark", table, {"upto": upto.isoformat()}, seq)
                return True
            except Conflict:
                continue
        return False

    # --- checkpoints -----------------------------------------------------------
    def checkpoint(self, table: str) -> int | None:
        value = self.get("checkpoint", table)[1]
        return value["version"] if value else None

    def set_checkpoint(self, table: str, version: int, mode: str) -> bool:
        """Record up to which version a target is made; nothing is added where that is known already."""
        seq, value = self.get("checkpoint", table)
        if value and value["version"] == version:
            return False
        self.put("checkpoint", table, {"version": version, "mode": mode}, seq)
        return True

    # --- migrations ------------------------------------------------------------
    def migrate(self, steps: Sequence[tuple[str, Callable[[], None]]]) -> list[str]:
        """Run the steps that were never applied, in order of their names; the names of those run.

        The lock is the first number of the series "migration/lock-<n>": of
        two callers one gets it, the other one a Conflict.
        """
        done = []
        turn, held = self.get("migration", "lock")
        if held and held["held"]:
            raise Conflict("migrations are running")
        self.put("migration", "lock", {"held": True}, turn)
        try:
            for name, run in sorted(steps, key=lambda s: s[0]):
                if not self.get("migration/applied", name)[0]:
                    run()
                    self.put("migration/applied", name, {"name": name}, 0)
                    done.append(name)
        finally:
            self.put("migration", "lock", {"held": False}, turn + 1)
        return done
