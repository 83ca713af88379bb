"""Fitted models as Parquet tables of parameters: a row for each array or number that a model holds.

Nothing is pickled, so a table can be read, compared and joined like any other, and loading one runs no stored code.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from logsift.operators.models import Forest, Network, OneClass, Subspace

MODELS = {m.__name__: m for m in (Subspace, Network, Forest, OneClass)}
SCHEMA = "model string, place string, kind string, shape array<long>, numbers array<double>"


def _rows(value: object, place: str) -> Iterator[tuple]:
    if isinstance(value, (list, tuple, dict)):
        items = value.items() if isinstance(value, dict) else enumerate(value)
        yield place, type(value).__name__, [len(value)], []
        for k, v in items:
            yield from _rows(v, f"{place}/{k}")
    elif isinstance(value, (np.ndarray, np.generic)):
        numbers = np.asarray(value)
        yield place, numbers.dtype.str, list(numbers.shape), numbers.ravel().astype(float).tolist()
    elif isinstance(value, (bool, int, float)):
        yield place, type(value).__name__, [], [float(value)]
    else:
        raise TypeError(f"{place} holds a {type(value).__name__}")


def parameters(spark: SparkSession, model: object) -> DataFrame:
    """(model, place, kind, shape, numbers) of a fitted Subspace, Network, Forest or OneClass. Whole numbers beyond 2**53
    are not exact."""
    name = type(model).__name__
    if name not in MODELS:
        raise TypeError(f"{name} is not one of {', '.join(MODELS)}")
    rows = [(name, *r) for f in fields(model) for r in _rows(getattr(model, f.name), f.name)]
    return spark.createDataFrame(rows, SCHEMA)


def save(spark: SparkSession, model: object, path: str) -> None:
    """Writes the parameters to a new Parquet table at path, which driver and executors must share."""
    parameters(spark, model).write.parquet(path)


def from_parameters(table: DataFrame) -> object:
    """The model of a table that parameters() made, whatever the order of its rows; the driver holds the model."""
    rows = {r["place"]: r for r in table.collect()}
    names = {r["model"] for r in rows.values()}
    if len(names) != 1 or not names <= set(MODELS):
        raise ValueError(f"not the parameters of one model: {sorted(map(str, names))}")
    model = MODELS[names.pop()]
    inside: dict[str, list[str]] = {}
    for place in rows:
        inside.setdefault(place.rpartition("/")[0], []).append(place.rpartition("/")[2])

    def built(place: str) -> object:
        r = rows[place]
        if r["kind"] in ("list", "tuple"):
            items = [built(f"{place}/{k}") for k in range(r["shape"][0])]
            return items if r["kind"] == "list" else tuple(items)
        if r["kind"] == "dict":
            return {k: built(f"{place}/{k}") for k in inside.get(place, [])}
        if r["kind"] in ("bool", "int", "float"):
            return {"bool": bool, "int": int, "float": float}[r["kind"]](r["numbers"][0])
        return np.array(r["numbers"], float).astype(r["kind"]).reshape(r["shape"])

    return model(**{f.name: built(f.name) for f in fields(model)})


def load(spark: SparkSession, path: str) -> object:
    return from_parameters(spark.read.schema(SCHEMA).parquet(path))
