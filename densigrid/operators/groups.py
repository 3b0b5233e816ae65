"""Python work on many small groups: a task walks through its sorted rows, so that a group costs a slice of arrays and not a call of its own."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

_KINDS = {"integer": "int32", "long": "int64", "double": "float64", "boolean": "bool"}


def by_group(rows: DataFrame, keys: list[str], order: list[str], work: Callable[[dict], list[tuple]], results: str) -> DataFrame:
    """The keys and ``results`` (DDL): ``work`` gets each group's other columns as arrays, sorted by ``order``, and returns any number of rows. A task holds a batch and one group."""
    more = T.StructType.fromDDL(results)
    schema = T.StructType([*(rows.schema[k] for k in keys), *more.fields])
    rest = [c for c in rows.columns if c not in keys]

    def done(block: pd.DataFrame, starts: np.ndarray, stops: np.ndarray) -> pd.DataFrame:
        columns = {c: block[c].to_numpy() for c in rest}
        names = [block[k].to_numpy() for k in keys]
        out = [(*(n[a] for n in names), *row) for a, b in zip(starts.tolist(), stops.tolist()) for row in work({c: v[a:b] for c, v in columns.items()})]
        return pd.DataFrame({f.name: pd.Series([row[i] for row in out], dtype=_KINDS.get(f.dataType.typeName(), object)) for i, f in enumerate(schema.fields)})

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch), dtype=bool)
            for i, k in enumerate(keys):
                v = batch[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
                new[0] |= last is None or v[0] != last[i]
            last = [batch[k].iloc[-1] for k in keys]
            starts = np.flatnonzero(new)
            if not len(starts):
                held.append(batch)
                continue
            end = starts[-1]
            block = pd.concat([*held, batch.iloc[:end]], ignore_index=True)
            shift = len(block) - end
            begins = starts[:-1] + shift
            begins = np.r_[0, begins[begins > 0]] if shift else begins
            held = [batch.iloc[end:]]
            if len(block):
                yield done(block, begins, np.r_[begins[1:], len(block)])
        if held:
            block = pd.concat(held, ignore_index=True)
            yield done(block, np.array([0]), np.array([len(block)]))

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(walk, schema)
