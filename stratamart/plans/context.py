"""What a model function sees: ``source``, ``ref`` and the ``as_of`` day."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Model:
    name: str
    build: Callable[["MartContext"], DataFrame]
    layer: str
    materialized: str = "view"
    watermark: str | None = None
    unique_key: str | None = None
    layout: tuple[str, ...] = ()
    # where models are stored one at a time, those of a higher one go first
    priority: int = 0


MODELS: dict[str, Model] = {}


def model(layer: str, materialized: str = "view", **config) -> Callable:
    """Register a ``fn(ctx) -> DataFrame`` under its own name."""

    def register(fn):
        MODELS[fn.__name__] = Model(fn.__name__, fn, layer, materialized, **config)
        return fn

    return register


class MartContext:
    """Resolves names to DataFrames.

    ``source(name)`` reads a raw table. ``ref(name)`` gives a model's result: the stored
    table if one was bound, else the model's own lazy plan (so a chain of views becomes a
    single plan for Catalyst). ``as_of`` stands for the current day, which keeps every
    model repeatable.
    """

    def __init__(self, source: Callable[[str], DataFrame], as_of: date) -> None:
        self._source = source
        self._bound: dict[str, DataFrame] = {}
        self._building: list[str] = []
        self.as_of = as_of

    def source(self, name: str) -> DataFrame:
        return self._source(name)

    def ref(self, name: str) -> DataFrame:
        if name not in self._bound:
            if name not in MODELS:
                raise KeyError(f"no model named {name!r}")
            if name in self._building:
                raise ValueError(f"models depend on each other in a circle: {' -> '.join([*self._building, name])}")
            self._building.append(name)
            try:
                self._bound[name] = MODELS[name].build(self)
            finally:
                self._building.pop()
        return self._bound[name]

    def bind(self, name: str, df: DataFrame) -> None:
        self._bound[name] = df
