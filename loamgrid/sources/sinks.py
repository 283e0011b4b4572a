"""Outputs beside tables: maps, rasters, polygons, topic-model files."""

from __future__ import annotations

from collections.abc import Sequence
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.grids import RegularGrid
from .scratch import written
from .textdb import Schema, write_small


def results_table(found: DataFrame, notes: dict[str, str], base: str) -> None:
    """Per-document results as a table, notes on the run as its fixed fields."""
    from .textdb import write

    write(found, base, Schema(list(found.columns), notes))


def cell_rows(cells: DataFrame, grid: RegularGrid) -> DataFrame:
    """One row per cell with documents: its box, centre, centroid and totals."""
    south, west = grid.corner(F.col("row"), F.col("col"))
    north, east = grid.corner(F.col("row"), F.col("col"), grid.width)
    lat, lon = grid.center(F.col("row"), F.col("col"))
    return cells.withColumns({"south": south, "west": west, "north": north, "east": east, "center_lat": lat, "center_lon": lon})


def scaled(x: Column, transform: str = "none") -> Column:
    """Bar height of a probability: itself, its logarithm, or the logarithm's square."""
    if transform == "none":
        return x
    log = F.ln(F.when(x > 0, x))
    return log if transform == "log" else -(log * log)


def kml(cells: Sequence, name: str, value: str, most_height: float = 2_000_000.0) -> str:
    """KML of boxes (south, west, north, east, value) as bars; for the cells of one word."""
    values = [c[value] for c in cells if c[value] is not None]
    low, high = min(values, default=0.0), max(values, default=1.0)
    marks = []
    for c in cells:
        if c[value] is None:
            continue
        height = most_height * ((c[value] - low) / (high - low) if high > low else 1.0)
        ring = " ".join(f"{x},{y},{height:.1f}" for y, x in ((c["south"], c["west"]), (c["south"], c["east"]), (c["north"], c["east"]), (c["north"], c["west"]), (c["south"], c["west"])))
        marks.append(
            f"<Placemark><name>{c[value]:.6g}</name><Polygon><extrude>1</extrude><altitudeMode>relativeToGround</altitudeMode>"
            f"<outerBoundaryIs><LinearRing><coordinates>{ring}</coordinates></LinearRing></outerBoundaryIs></Polygon></Placemark>"
        )
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(name)}</name>{"".join(marks)}</Document></kml>\n'


def placemarks(points: Sequence, name: str) -> str:
    """KML of (label, lat, lon, n) points."""
    marks = "".join(f"<Placemark><name>{escape(str(p['label']))} ({p['n']})</name><Point><coordinates>{p['lon']},{p['lat']}</coordinates></Point></Placemark>" for p in points)
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>{escape(name)}</name>{marks}</Document></kml>\n'


def grouped_points(rows: DataFrame, label: str) -> DataFrame:
    """(label, lat, lon, n): equal places counted, the table behind placemarks and heat maps."""
    return rows.groupBy(F.col(label).alias("label"), "lat", "lon").agg(F.count(F.lit(1)).alias("n"))


def heatmap_points(found: DataFrame, mode: str = "all", other: DataFrame | None = None) -> DataFrame:
    """(lat, lon) of correct places: all, those not predicted exactly, or those where two runs differ."""
    if mode == "all":
        return found.select("lat", "lon")
    if mode == "errors":
        return found.filter(F.col("correct_rank") > 1).select("lat", "lon")
    joined = found.join(other.select("doc", F.col("pred_cell").alias("_p")), "doc")
    return joined.filter(F.col("pred_cell") != F.col("_p")).select("lat", "lon")


def script_points(points: Sequence) -> str:
    """A list of [lat, lon] for a page's script."""
    return "var points = [" + ", ".join(f"[{p['lat']}, {p['lon']}]" for p in points) + "];\n"


def raster(probs: Sequence, grid: RegularGrid, missing: float = -9999.0) -> str:
    """ASCII grid of (row, col, p) for one word, the northmost row first, in all four quadrants."""
    rows, cols = [p["row"] for p in probs], [p["col"] for p in probs]
    r0, r1, c0, c1 = min(rows), max(rows), min(cols), max(cols)
    at = {(p["row"], p["col"]): p["p"] for p in probs}
    head = [
        f"ncols {c1 - c0 + 1}", f"nrows {r1 - r0 + 1}", f"xllcorner {c0 * grid.degrees}", f"yllcorner {r0 * grid.degrees}",
        f"cellsize {grid.degrees}", f"NODATA_value {missing:g}",
    ]
    body = [" ".join(f"{at.get((r, c), missing):g}" for c in range(c0, c1 + 1)) for r in range(r1, r0 - 1, -1)]
    return "\n".join([*head, *body]) + "\n"


def polygons(cells: DataFrame, grid: RegularGrid) -> DataFrame:
    """(row, col, corner, lat, lon): four corners of each cell; cells across the antimeridian are left out."""
    out = cell_rows(cells, grid).filter(F.col("west") < F.col("east"))
    corners = [("south", "west"), ("north", "west"), ("north", "east"), ("south", "east")]
    rows = F.array(*[F.struct(F.lit(i).alias("corner"), F.col(a).alias("lat"), F.col(b).alias("lon")) for i, (a, b) in enumerate(corners)])
    return out.select("row", "col", F.explode(rows).alias("c")).select("row", "col", "c.corner", "c.lat", "c.lon")


def topic_model_tables(doc_grams: DataFrame, docs: DataFrame) -> dict[str, DataFrame]:
    """Tables of a dynamic topic model: vocab (word, id), slice (slice, n), doc (doc, place, slice), mult (place, line).

    doc_grams: (doc, gram, cnt), written; docs: (doc, slice).  Documents go by
    slice, then by id; word ids by the words' order.  The lines are made by
    document and take their place afterwards.
    """
    from ..operators.models import join_by_gram
    from ..operators.rows import with_positions

    words = written(doc_grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df")), "words")
    words = written(with_positions(words, ["gram"]).select("gram", "df", F.col("position").alias("id")), "vocabulary")
    vocab = words.select("gram", "id")
    placed = with_positions(docs.select("slice", "doc"), ["slice", "doc"]).withColumnRenamed("position", "place")
    pairs = join_by_gram(doc_grams, words)
    items = F.transform(F.array_sort(F.collect_list(F.struct("id", F.col("cnt").cast("int").alias("n")))), lambda p: F.concat_ws(":", p["id"].cast("string"), p["n"].cast("string")))
    lines = pairs.groupBy("doc").agg(items.alias("_i")).select("doc", F.concat(F.size("_i").cast("string"), F.lit(" "), F.array_join("_i", " ")).alias("line"))
    lines = lines.join(placed.select("doc", "place"), "doc").select("place", "line")
    slices = docs.groupBy("slice").agg(F.count(F.lit(1)).alias("n"))
    return {"vocab": vocab, "slice": slices, "doc": placed, "mult": lines}


def write_text(df: DataFrame, path: str, text: str) -> None:
    """A rendered result into one file, through Spark's file system."""
    write_small(df.sparkSession, path, text)


def partitioned(rows: DataFrame, field: str, path: str, records: int = 1_000_000) -> None:
    """A folder for each value, files of at most `records` rows."""
    rows.write.option("maxRecordsPerFile", records).partitionBy(field).parquet(path)


def first_time_per_file(events: DataFrame) -> DataFrame:
    """(path, first_at): names for split files."""
    return events.groupBy("path").agg(F.min("ts").alias("first_at"))


def numbered_lines(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("line_no", F.row_number().over(Window.partitionBy("path").orderBy(order)))
