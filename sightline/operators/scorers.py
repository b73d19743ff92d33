"""Scoring functions by task and name: any model that turns a batch of rows into a batch of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
_SCORERS: dict[tuple[str, str], tuple[Scorer, str]] = {}


def register_scorer(task: str, name: str, fn: Scorer, schema: str) -> None:
    """Make ``fn`` known under a task and name; ``schema`` is that of its output."""
    _SCORERS[task, name] = fn, schema


def scorers(task: str | None = None) -> list[tuple[str, str]]:
    return sorted(k for k in _SCORERS if task in (None, k[0]))


def score(df: DataFrame, task: str, name: str) -> DataFrame:
    """Rows through a registered scorer, batch by batch; the key column that it carries makes order irrelevant."""
    if (task, name) not in _SCORERS:
        raise KeyError(f"no scorer {name!r} for {task!r}; known: {scorers(task)}")
    fn, schema = _SCORERS[task, name]
    return df.mapInPandas(fn, schema)


def one_by_one_on_failure(batch: Callable[[pd.DataFrame], pd.DataFrame], key: str, empty: pd.DataFrame) -> Scorer:
    """A scorer that falls back to single rows when a batch fails, leaving out those that fail alone, and checks keys."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            try:
                out = batch(rows)
            except Exception:
                found = [empty]
                for i in range(len(rows)):
                    try:
                        found.append(batch(rows.iloc[i : i + 1]))
                    except Exception:  # noqa: S112  a row that can't be scored has no result
                        continue
                out = pd.concat(found)
            if not set(out[key]) <= set(rows[key]):
                raise ValueError("a scorer returned keys that it wasn't given")
            yield out

    return run


def embed(values: Column, fn: Callable[[pd.Series], pd.Series]) -> Column:
    """Vectors of a column of values by a function on series."""

    @F.pandas_udf("array<float>")
    def run(s: pd.Series) -> pd.Series:
        return fn(s)

    return run(values)
