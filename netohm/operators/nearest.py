"""Nearest points by a grid: points lie in a table by cell, and a look-up reads the cells around a place, ring by ring.

The grid spans the points with about `per_cell` of them a cell on average, in at most MOST columns and rows. The table is partitioned by column and
sorted by row, so Spark leaves out other columns' files and, by the Parquet statistics, other rows' groups. A look-up takes the
cells within r of the place's own, which hold every point nearer than the border of that square; r doubles until the
nearest point found is no farther than the border.

Points with a null, NaN or infinite coordinate are left out; ties go to the least keys; no row where the radius holds no point.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netohm.sources.shared import scratch

PER_CELL, MOST = 2_000, 256


@dataclass(frozen=True)
class Grid:
    """The table of points with their cells (gx, gy) and its extent."""

    points: DataFrame
    x: str
    y: str
    keys: tuple[str, ...]
    low: tuple[float, float]
    step: tuple[float, float]
    cells: int

    def around(self, at: tuple[float, float], r: int) -> DataFrame:
        """The points of the cells within r of the place's."""
        out = self.points
        for g, p, low, step in zip(("gx", "gy"), at, self.low, self.step):
            own = int(min(max((p - low) // step, 0), self.cells - 1))
            out = out.where(F.col(g).between(own - r, own + r))
        return out

    def border(self, at: tuple[float, float], r: int) -> float:
        """How near a point outside those cells can be."""
        gaps = []
        for p, low, step in zip(at, self.low, self.step):
            own = int(min(max((p - low) // step, 0), self.cells - 1))
            # outside the grid there are no points
            gaps += [p - (low + (own - r) * step)] if own - r > 0 else []
            gaps += [low + (own + r + 1) * step - p] if own + r < self.cells - 1 else []
        return max(min(gaps, default=float("inf")) * (1 - 1e-9), 0.0)  # cells' borders are rounded

    def nearest(self, at: tuple[float, float], radius: float | None = None) -> DataFrame:
        """The point next to a place, with d2, its squared distance; with a radius only within it."""
        d2 = (F.col(self.x) - at[0]) ** 2 + (F.col(self.y) - at[1]) ** 2
        r = 0
        while True:
            rows = self.around(at, r).withColumn("d2", d2)
            found = (rows if radius is None else rows.where(F.col("d2") <= radius * radius)).orderBy("d2", *self.keys).limit(1)
            border = self.border(at, r)
            got = found.select("d2").collect()  # one row at most
            # a point on the border itself may be a tie, so it has to lie inside
            if (got and got[0]["d2"] < border * border) or border == float("inf") or (radius is not None and border > radius):
                return found.drop("gx", "gy")
            r = max(1, 2 * r)


def grid(df: DataFrame, x: str, y: str, keys: list[str], per_cell: int = PER_CELL) -> Grid:
    """df as a grid of its points, kept as a table in the shared folder."""
    whole = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    rows = df.where(whole(x) & whole(y))
    e = rows.agg(F.count("*").alias("n"), *[f(c).cast("double").alias(f"{n}_{i}") for i, c in enumerate((x, y)) for n, f in (("a", F.min), ("z", F.max))]).first()
    cells = int(min(max((e["n"] / per_cell) ** 0.5, 1), MOST))
    low = tuple(e[f"a_{i}"] or 0.0 for i in (0, 1))
    step = tuple(((e[f"z_{i}"] or 0.0) - low[i]) / cells or 1.0 for i in (0, 1))
    cell = lambda c, i: F.least(F.floor((F.col(c) - low[i]) / step[i]), F.lit(cells - 1)).cast("int")
    placed = rows.withColumn("gx", cell(x, 0)).withColumn("gy", cell(y, 1))
    path = scratch(df.sparkSession, "grid")
    placed.repartitionByRange("gx", "gy").sortWithinPartitions("gx", "gy").write.partitionBy("gx").parquet(path)
    schema = placed.drop("gx").withColumn("gx", F.lit(0)).schema
    return Grid(df.sparkSession.read.schema(schema).parquet(path), x, y, tuple(keys), low, step, cells)
