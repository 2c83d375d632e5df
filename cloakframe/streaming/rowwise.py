"""Row-wise operators on unbounded streams: generalization at fixed levels, and noise with fixed parameters.

Everything else needs the whole table. Run that by foreachBatch if a batch is a release of its own; classes of k rows
in each batch are not classes of k rows overall.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..hierarchy import Hierarchy
from ..operators.generalize import generalize_column


def generalize_stream(df: DataFrame, hierarchies: dict[str, Hierarchy], levels: dict[str, int]) -> DataFrame:
    """Takes each column of a stream to its level; hierarchies of rules only, so that the plan stays stateless."""
    for c, level in levels.items():
        if hierarchies[c].mapping is not None:
            raise ValueError(f"{c}: a stream needs a hierarchy of rules")
        if level:
            df = generalize_column(df, c, hierarchies[c], 0, level)
    return df


def per_batch(release: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that skips empty batches."""

    def run(batch: DataFrame, number: int) -> None:
        if batch.limit(1).count():
            release(batch, number)

    return run
