"""Decisions without data: what to extract, how to load, what a changed schema means, which steps to run."""

from __future__ import annotations

import functools
import math
import time
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql.types import ByteType, DataType, DateType, DoubleType, FloatType, IntegerType, LongType, ShortType, StructType, TimestampNTZType, TimestampType

#: The time before all data, a chunk's length, what makes a file small, rows to a file and to a writer.
BEGINNING = datetime(1900, 1, 1)
CHUNK_DAYS, MOST_CHUNKS = 31, 1000
MIN_FILES, SMALL_MB = 16, 32
ROWS_PER_FILE, ROWS_PER_WRITER, MOST_WRITERS = 1_000_000, 50_000, 4


@dataclass(frozen=True)
class Extraction:
    low: datetime
    high: datetime | None
    backfill: bool


def extraction_window(watermark: datetime | None, lookback_minutes: int = 0, start: datetime | None = None, end: datetime | None = None) -> Extraction:
    """What to read: from the watermark less the overlap on, or exactly [start, end) in a backfill."""
    if lookback_minutes < 0:
        raise ValueError("the overlap is negative")
    if start is None and end is None:
        return Extraction((watermark or BEGINNING) - (timedelta(minutes=lookback_minutes) if watermark else timedelta()), None, False)
    low = start or BEGINNING
    if end is not None and end <= low:
        raise ValueError("the window ends before it starts")
    return Extraction(low, end, True)


def split_window(start: datetime, end: datetime, days: int = CHUNK_DAYS, most: int = MOST_CHUNKS) -> list[tuple[datetime, datetime]]:
    """Adjoining half-open chunks, the last one cut at the end."""
    if days <= 0 or end <= start:
        raise ValueError("a window needs a positive length and chunk size")
    n = math.ceil((end - start) / timedelta(days=days))
    if n > most:
        raise ValueError(f"{n} chunks; {most} are allowed")
    return [(start + timedelta(days=days * k), min(end, start + timedelta(days=days * (k + 1)))) for k in range(n)]


def load_mode(checkpoint: int | None, version: int, feed_since: int | None, target_exists: bool, force: bool = False) -> tuple[str, str]:
    """(full | skip | incremental, why).

    The target holds the source's versions up to the checkpoint.  It can go on
    from there if the change feed keeps every version in between; a target that
    is missing, ahead of its source or to be made anew holds nothing of use.
    """
    usable = target_exists and not force and checkpoint is not None and checkpoint <= version
    lacking = range(checkpoint + 1 if usable else 0, version + 1)
    kept = range(version + 1 if feed_since is None else feed_since, version + 1)
    if not usable:
        return "full", f"the target has no usable state (checkpoint {checkpoint}, source at {version}{', forced' if force else ''})"
    if not lacking:
        return "skip", f"version {version} is merged"
    if lacking.start < kept.start:
        return "full", f"changes from version {lacking.start} on are needed, the feed {f'starts at {feed_since}' if feed_since is not None else 'is off'}"
    return "incremental", f"versions {lacking.start} to {version}"


#: Bits of whole numbers, and whole numbers' bits that fractions hold without loss.
_WHOLE = {ByteType: 8, ShortType: 16, IntegerType: 32, LongType: 64}
_EXACT = {FloatType: 24, DoubleType: 53}


def lossless(given: DataType, wanted: DataType) -> bool:
    """Whether every value of one type is a value of the other."""
    a, b = type(given), type(wanted)
    if a in _WHOLE:
        return _WHOLE[a] <= (_WHOLE | _EXACT).get(b, 0)
    if a in _EXACT:
        return _EXACT[a] <= _EXACT.get(b, 0)
    return a is DateType and b in (TimestampType, TimestampNTZType)


@dataclass(frozen=True)
class Change:
    """One difference of an incoming schema, and what is done about it: evolve, cast, fill_null or reject."""

    column: str
    kind: str
    old: str | None
    new: str | None
    action: str


class SchemaRejected(ValueError):
    pass


def drift(accepted: StructType | None, incoming: StructType, removed: str = "reject", ignore: Iterable[str] = ()) -> list[Change]:
    """Differences, in the order of the incoming and then of the accepted columns; names regardless of case.

    On a first load there are none.  Columns in ``ignore``, such as the ones
    that the load itself adds, do not count on either side.
    """
    if accepted is None:
        return []
    skipped = {c.lower() for c in ignore}
    have, new = ({f.name.lower(): f.dataType for f in schema if f.name.lower() not in skipped} for schema in (accepted, incoming))
    out = [Change(c, "added", None, t.simpleString(), "evolve") for c, t in new.items() if c not in have]
    for c, t in new.items():
        if c in have and t != have[c]:
            out.append(Change(c, "type_changed", have[c].simpleString(), t.simpleString(), "cast" if lossless(t, have[c]) else "reject"))
    return out + [Change(c, "removed", t.simpleString(), None, removed) for c, t in have.items() if c not in new]


def enforce(changes: Sequence[Change]) -> Sequence[Change]:
    """The changes, if all of them can be taken."""
    refused = [f"{c.column}: {c.kind} ({c.old} to {c.new})" for c in changes if c.action == "reject"]
    if refused:
        raise SchemaRejected("; ".join(refused))
    return changes


def plan_steps(steps: Sequence[str], first: str | None = None, last: str | None = None) -> list[str]:
    """The steps from one to another, both included."""
    place = {s: k for k, s in enumerate(steps)}
    try:
        bounds = place[first if first is not None else steps[0]], place[last if last is not None else steps[-1]]
    except KeyError as e:
        raise ValueError(f"no step {e.args[0]}") from e
    chosen = [s for s in steps if bounds[0] <= place[s] <= bounds[1]]
    if not chosen:
        raise ValueError(f"{last} comes before {first}")
    return chosen


def resume_point(steps: Sequence[str], states: dict[str, str]) -> str | None:
    """Where a run goes on: its first step that did not succeed, from the first one that it recorded on."""
    todo = list(steps)
    while todo and states and todo[0] not in states:
        todo.pop(0)
    return next((s for s in todo if states.get(s) != "SUCCESS"), None)


def retry(attempts: int = 3, delay: float = 1.0, on: tuple[type[Exception], ...] = (Exception,), sleep: Callable[[float], None] = time.sleep):
    """Call again after a failure, waiting twice as long each time."""
    waits = [delay * 2**k for k in range(attempts - 1)]

    def wrap(f):
        @functools.wraps(f)
        def run(*a, **b):
            for wait in waits:
                try:
                    return f(*a, **b)
                except on:
                    sleep(wait)
            return f(*a, **b)

        return run

    return wrap


def worth_compacting(sizes: Sequence[int], min_files: int = MIN_FILES, small_mb: float = SMALL_MB) -> bool:
    """Whether a table has many files that are small on average."""
    return len(sizes) > 1 and len(sizes) >= min_files and sum(sizes) < small_mb * 2**20 * len(sizes)


def files_for(rows: int, rows_per_file: int = ROWS_PER_FILE) -> int:
    return max(1, math.ceil(rows / rows_per_file))


def writers_for(rows: int, rows_per_writer: int = ROWS_PER_WRITER, most: int = MOST_WRITERS) -> int:
    """A connection for each whole share of rows, within 1 and ``most``."""
    return sorted((1, rows // rows_per_writer, most))[1]
