"""Source adapters by name: functions that return a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.sources import readers

_ADAPTERS: dict[str, Callable[..., DataFrame]] = {}


def adapter(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Registers a function under a name that must be new."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in _ADAPTERS:
            raise ValueError(f"{name} is registered")
        _ADAPTERS[name] = f
        return f

    return register


def build(name: str) -> Callable[..., DataFrame]:
    return _ADAPTERS[name]


def names() -> list[str]:
    return sorted(_ADAPTERS)


adapter("json_lines")(readers.read_json_lines)
adapter("checked_parquet")(readers.read_records)
adapter("csv")(readers.read_csv)


@adapter("ranked_table")
def ranked_table(results: DataFrame, request: str) -> DataFrame:
    """Search results of a request from a table of stored ones, in their rank."""
    return results.where(F.col("request") == request).orderBy("rank")


_REWARDS: dict[str, Callable[..., Callable[[Column], Column]]] = {}


def rewards(name: str) -> Callable:
    """Registers a maker of rewards under a name that must be new; what it makes maps a column to a reward."""

    def register(make: Callable[..., Callable[[Column], Column]]) -> Callable:
        if name in _REWARDS:
            raise ValueError(f"{name} is registered")
        _REWARDS[name] = make
        return make

    return register


def reward(name: str, **settings: float) -> Callable[[Column], Column]:
    """The reward of a registered name with its settings; an unknown name is an error that lists the known ones."""
    if name not in _REWARDS:
        raise ValueError(f"no reward {name}: {', '.join(sorted(_REWARDS))}")
    return _REWARDS[name](**settings)


@rewards("clipped")
def clipped(scale: float = 1.0) -> Callable[[Column], Column]:
    return lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / scale))


@rewards("threshold")
def threshold(least: float) -> Callable[[Column], Column]:
    return lambda x: (x > least).cast("double")
