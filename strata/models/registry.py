"""Models as functions of other models, built in the order that their needs give."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    name: str
    needs: tuple[str, ...]
    build: Callable[..., DataFrame]
    table: bool


MODELS: dict[str, Model] = {}


def model(*needs: str, table: bool = False):
    """Register a function whose arguments are the frames of ``needs``; ``table`` ones are written when a folder is given."""

    def wrap(f):
        MODELS[f.__name__] = Model(f.__name__, needs, f, table)
        return f

    return wrap


def order(names: Iterable[str] | None = None) -> list[str]:
    """Models that the named ones need, and they, each after what it needs; sources are left out."""
    graph, todo = {}, list(names if names is not None else MODELS)
    while todo:
        name = todo.pop()
        if name in MODELS and name not in graph:
            graph[name] = MODELS[name].needs
            todo += MODELS[name].needs
    return [n for n in TopologicalSorter(graph).static_order() if n in MODELS]


def build(sources: Mapping[str, DataFrame], names: Iterable[str] | None = None, folder: str | None = None) -> dict[str, DataFrame]:
    frames = dict(sources)
    for name in order(names):
        m = MODELS[name]
        missing = [n for n in m.needs if n not in frames]
        if missing:
            raise KeyError(f"{name} needs {missing}")
        df = m.build(*(frames[n] for n in m.needs))
        if m.table and folder is not None:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
            df = df.sparkSession.read.parquet(f"{folder}/{name}")
        frames[name] = df
    return frames
