"""Column names that an operator adds itself."""

from __future__ import annotations

from pyspark.sql import DataFrame


def reserve(df: DataFrame, *names: str) -> None:
    """Raise where the input has a column, in any case, by a name that the operator is about to add."""
    taken = {c.lower() for c in df.columns} & {n.lower() for n in names}
    if taken:
        raise ValueError(f"the input has columns that the operator adds itself: {sorted(taken)}")
