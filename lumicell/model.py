"""The data set: long counts with cell and gene tables.

Absent pairs are zeros.  No operator makes the dense grid: what zeros add to a
mean, a rank or a median is worked out from the number of cells.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class CellData:
    """counts(cell, gene, value), obs(cell, ...), var(gene, ...), embeddings by name (cell, vec)."""

    counts: DataFrame
    obs: DataFrame
    var: DataFrame
    embeddings: dict[str, DataFrame] = field(default_factory=dict)

    def with_counts(self, counts: DataFrame) -> CellData:
        return replace(self, counts=counts)

    def n_cells(self) -> DataFrame:
        """One row: n_cells."""
        return self.obs.agg(F.count(F.lit(1)).alias("n_cells"))

    def labelled(self, *keys: str) -> DataFrame:
        """counts with columns of obs."""
        return self.counts.join(self.obs.select("cell", *keys), "cell")

    def group_sizes(self, *keys: str) -> DataFrame:
        """Cells of each group, those without counts included."""
        return self.obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells"))
