"""Tables of the queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grids import RegularGrid
from ..sources.scratch import scratch, written

__all__ = ["cell_name", "cell_sql", "millis", "placed", "placed_sql", "scratch", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(rows: DataFrame, key: str) -> DataFrame:
    """Rows with a coordinate made from their key; the tables have none."""
    lat = (F.col(key) * 7919 % 18000).cast("double") / 100 - 90
    lon = (F.col(key) * 104729 % 36000).cast("double") / 100 - 180
    return rows.withColumns({"lat": lat, "lon": lon})


def placed_sql(key: str) -> str:
    return f"CAST({key} * 7919 % 18000 AS DOUBLE) / 100 - 90 AS lat, CAST({key} * 104729 % 36000 AS DOUBLE) / 100 - 180 AS lon"


def cell_name(grid: RegularGrid) -> Column:
    row, col = grid.cell(F.col("lat"), F.col("lon"))
    return F.concat_ws(",", row.cast("string"), col.cast("string"))


def cell_sql(degrees: int) -> str:
    per = f"(CAST(1 AS DOUBLE) / {degrees})"
    return f"CAST(floor(lat * {per} + 1e-8) AS INT) AS \"row\", CAST(floor(lon * {per} + 1e-8) AS INT) AS col"


def millis(at: str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({at} AS TIMESTAMP_NTZ))")
