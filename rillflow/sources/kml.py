"""Contour sheets (KML and KMZ) as DataFrames.

Files are read as whole binaries, one row each, and turned into one row per placemark in
Arrow batches; folders may nest to any depth, so a row tag is not enough. What follows, the
search for heights and the measures of a sheet, is column expressions and aggregates.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import settings
from ..errors import AnalysisError
from ..functions import scalars

SCHEMA = """path string, error string, document string, nth int, name string, folders array<string>, ignored boolean,
attributes map<string, string>, lines array<array<struct<x: double, y: double, z: double>>>"""


def _local(tag: object) -> str:
    """Name of an element without its namespace."""
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


def _child_text(element, name: str) -> str | None:
    return next(((c.text or "").strip() for c in element if _local(c.tag) == name), None)


def coordinates(text: str) -> list[dict[str, float]]:
    """Points of a coordinate list; blanks around commas are allowed, a missing height is NaN."""
    points = []
    for part in re.sub(r"\s*,\s*", ",", (text or "").strip()).split():
        numbers = part.split(",")
        if len(numbers) < 2:
            raise AnalysisError("unparseable_geometry", f"{part!r} is no coordinate.", status=400)
        try:
            x, y, z = float(numbers[0]), float(numbers[1]), float(numbers[2]) if len(numbers) > 2 and numbers[2].strip() else float("nan")
        except ValueError:
            raise AnalysisError("unparseable_geometry", f"{part!r} is no coordinate.", status=400) from None
        points.append({"x": x, "y": y, "z": z})
    return points


def kml_of(data: bytes) -> bytes:
    """The sheet itself: the file, or the first KML of an archive, ``doc.kml`` before others, shallow before deep."""
    if len(data) > settings.sheet.largest_file:
        raise AnalysisError("file_too_large", "The sheet is larger than allowed.", status=413)
    if data[:4] != b"PK\x03\x04":
        return data
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = [n for n in z.namelist() if n.lower().endswith(".kml")]
            if not names:
                raise AnalysisError("unreadable_file", "The archive holds no KML.", status=400)
            return z.read(min(names, key=lambda n: (n.rpartition("/")[2].lower() != "doc.kml", n.count("/"), n.lower())))
    except zipfile.BadZipFile:
        raise AnalysisError("unreadable_file", "The archive can't be read.", status=400) from None


def placemarks_of(data: bytes) -> Iterator[dict]:
    """Every placemark with the folders around it; those below a folder of labels are marked."""
    try:
        root = ElementTree.fromstring(kml_of(data).lstrip())
    except ElementTree.ParseError as e:
        raise AnalysisError("unparseable_xml", f"The sheet is no XML: {e}", status=400) from None
    labels = re.compile(settings.sheet.skipped_folders, re.IGNORECASE)
    title = next((t for e in root.iter() if _local(e.tag) == "Document" and (t := _child_text(e, "name")) is not None), None)
    todo = [(root, (), False)]
    while todo:
        element, folders, ignored = todo.pop()
        kind = _local(element.tag)
        if kind == "Placemark":
            lines, attributes = [], []
            for e in element.iter():
                if _local(e.tag) in ("LineString", "LinearRing") and len(points := coordinates(_child_text(e, "coordinates") or "")) > 1:
                    lines.append(points)
                elif _local(e.tag) == "SimpleData" and e.get("name"):
                    attributes.append((e.get("name"), e.text or ""))
                elif _local(e.tag) == "Data" and e.get("name"):
                    attributes.append((e.get("name"), _child_text(e, "value") or e.text or ""))
            yield {"document": title, "name": _child_text(element, "name"), "folders": list(folders), "ignored": ignored, "attributes": list(dict(attributes).items()), "lines": lines}
            continue
        if kind in ("Folder", "Document") and (name := _child_text(element, "name")) is not None:
            folders, ignored = (*folders, name), ignored or bool(labels.search(name))
        todo += [(child, folders, ignored) for child in reversed(element)]


def read_placemarks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each placemark of all sheets under a path; a sheet that can't be read is one row with ``error``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        point = pa.struct([("x", pa.float64()), ("y", pa.float64()), ("z", pa.float64())])
        schema = pa.schema([("path", pa.string()), ("error", pa.string()), ("document", pa.string()), ("nth", pa.int32()), ("name", pa.string()), ("folders", pa.list_(pa.string())), ("ignored", pa.bool_()), ("attributes", pa.map_(pa.string(), pa.string())), ("lines", pa.list_(pa.list_(point)))])
        for b in batches:
            for file, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows = [{"path": file, "nth": n, **p} for n, p in enumerate(placemarks_of(content))]
                except AnalysisError as e:
                    rows = [{"path": file, "error": e.code}]
                for lo in range(0, len(rows), 500):
                    yield pa.RecordBatch.from_pylist(rows[lo : lo + 500], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, SCHEMA)


def heights(placemarks: DataFrame) -> DataFrame:
    """(path, nth, lines, strategy, height): one way of telling heights for each sheet.

    The ways are tried in the order of the settings; the first that gives nine tenths of the
    lines a height, at two levels at least, is taken. Sheets without one drop out here and
    show up in ``problems``.
    """
    ways = {
        "z_coordinate": scalars.height_from_z(F.flatten(F.transform("lines", lambda line: F.transform(line, lambda p: p["z"])))),
        "extended_data": scalars.height_from_attributes(F.col("attributes")),
        "placemark_name": scalars.labelled_number(F.col("name"))["value"],
        "folder_name": scalars.height_from_folders(F.col("folders")),
    }
    order = settings.sheet.height_sources
    drawn = placemarks.where(F.col("error").isNull() & ~F.col("ignored") & (F.size("lines") > 0))
    wide = drawn.select("path", "nth", "lines", *(ways[w].alias(w) for w in order))
    coverage = wide.groupBy("path").agg(
        *(F.avg(F.col(w).isNotNull().cast("double")).alias(f"{w}_share") for w in order),
        *(F.count_distinct(F.round(w, 6)).alias(f"{w}_levels") for w in order),
    )
    fits = [F.when((F.col(f"{w}_share") >= settings.sheet.source_coverage) & (F.col(f"{w}_levels") >= settings.sheet.least_levels), w) for w in order]
    chosen = coverage.select("path", F.coalesce(*fits).alias("strategy"))
    value = F.coalesce(*(F.when(F.col("strategy") == w, F.col(w)) for w in order))
    return wide.join(chosen, "path").where("strategy is not null").select("path", "nth", "lines", "strategy", value.alias("height")).where("height is not null")


def problems(placemarks: DataFrame) -> DataFrame:
    """(path, code) of sheets that give no contours, and why."""
    p = settings.sheet
    usable = heights(placemarks).groupBy("path").agg(F.count("*").alias("n_usable"))
    flat = F.max(F.coalesce(scalars.height_from_z(F.flatten(F.transform("lines", lambda line: F.transform(line, lambda q: q["z"])))), scalars.labelled_number(F.col("name"))["value"], scalars.height_from_folders(F.col("folders"))).isNotNull())
    drawn = F.coalesce(~F.col("ignored"), F.lit(False)) & (F.coalesce(F.size("lines"), F.lit(0)) > 0)
    sums = placemarks.groupBy("path").agg(F.max("error").alias("error"), F.sum(F.when(drawn, F.size("lines")).otherwise(0)).alias("n_lines"), flat.alias("flat"))
    joined = sums.join(usable, "path", "left")
    code = F.coalesce("error", F.when(F.col("n_lines") < p.least_lines, "no_contours").when(F.col("n_usable").isNull() & F.col("flat"), "too_few_levels").when(F.col("n_usable").isNull(), "no_elevations"))
    return joined.select("path", code.alias("code")).where("code is not null")


def vertices(placemarks: DataFrame) -> DataFrame:
    """(path, line_id, seq, lon, lat, z): every vertex of every contour, with its contour's height."""
    lines = heights(placemarks).select("path", "nth", "height", F.posexplode("lines").alias("part", "line"))
    points = lines.select("path", F.struct("nth", "part").alias("line_id"), "height", F.posexplode("line").alias("seq", "p"))
    return points.select("path", "line_id", "seq", F.col("p.x").alias("lon"), F.col("p.y").alias("lat"), F.col("height").alias("z"))


def sheet_summary(placemarks: DataFrame) -> DataFrame:
    """One row for each sheet: lines, vertices, box, levels, and the interval between them."""
    v = vertices(placemarks)
    sums = v.groupBy("path").agg(F.count_distinct("line_id").alias("n_lines"), F.count("*").alias("n_vertices"), F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"))
    levels = v.select("path", F.round("z", 6).alias("level")).distinct()
    steps = levels.withColumn("step", F.col("level") - F.lag("level").over(W.partitionBy("path").orderBy("level")))
    per_sheet = steps.groupBy("path").agg(F.array_sort(F.collect_list("level")).alias("levels"), F.median("step").alias("interval"))
    low, high = settings.sheet.feet_steps
    return sums.join(per_sheet, "path").withColumn("maybe_feet", F.col("interval").between(low, high))


def label_check(labels: DataFrame, levels: DataFrame) -> DataFrame:
    """(path, consistent) of sheets with labels (path, name): whether every height that a label gives is a level (path, level).

    Heights are compared at six decimals; labels without a number say nothing.
    """
    said = labels.select("path", F.round(scalars.labelled_number(F.col("name"))["value"], 6).alias("level")).where("level is not null").distinct()
    known = levels.select("path", F.round("level", 6).alias("level")).distinct().withColumn("known", F.lit(True))
    return said.join(known, ["path", "level"], "left").groupBy("path").agg(F.every(F.col("known").isNotNull()).alias("consistent"))


def sheet_labels(placemarks: DataFrame) -> DataFrame:
    """(path, consistent) of whole sheets: their placemarks without lines against the levels of their contours."""
    spots = placemarks.where(F.col("error").isNull() & (F.coalesce(F.size("lines"), F.lit(0)) <= 0)).select("path", "name")
    return label_check(spots, heights(placemarks).select("path", F.col("height").alias("level")))


def contour_lengths(points: DataFrame) -> DataFrame:
    """(path, length_m) of vertices (path, line_id, seq, x, y); jumps between lines don't count."""
    order = W.partitionBy("path", "line_id").orderBy("seq")
    step = F.hypot(F.col("x") - F.lag("x").over(order), F.col("y") - F.lag("y").over(order))
    return points.withColumn("step", step).groupBy("path").agg(F.sum("step").alias("length_m"))
