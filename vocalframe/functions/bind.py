"""Compute expressions exactly once per row.

Catalyst collapses adjacent projections and may copy an expensive expression
into each place that uses it (we measured the normalisation chain evaluated ten
times per row in the scoring plan). Emitting the values from a one-element
``inline(array(struct(...)))`` generator makes them real row attributes: the
optimiser does not inline generator output into its consumers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(df: DataFrame, cols: dict[str, Column], drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``cols`` to ``df`` as once-evaluated attributes; optionally drop inputs."""
    keep = [F.col(c) for c in df.columns if c not in cols and c not in drop]
    return df.select(*keep, F.inline(F.array(F.struct(*[v.alias(k) for k, v in cols.items()]))))
