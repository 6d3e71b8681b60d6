"""Sinks: GeoJSON features, JSON results, DXF text, binary PLY, raster sidecars.

Writers of single files take bounded tables (a plan, a decimated cloud) through the driver, as the
formats have one header and one body; ``writers`` writes folders of parts from the executors.
"""

from __future__ import annotations

import json
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_features(segments: DataFrame) -> DataFrame:
    """One GeoJSON LineString feature a segment."""
    geometry = F.struct(F.lit("LineString").alias("type"), F.array(F.array("x1", "y1"), F.array("x2", "y2")).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(F.col("seg_id").alias("id")).alias("properties"))
    return segments.select("seg_id", F.to_json(feature).alias("feature"))


def feature_collection(segments: DataFrame, bounds: tuple[float, float, float, float]) -> str:
    """A plan as one collection; its bounds as a rectangle where it has no segments."""
    rows = [json.loads(r["feature"]) for r in line_features(segments).orderBy("seg_id").toLocalIterator()]
    if not rows:
        x0, y0, x1, y1 = bounds
        ring = [[x0, y0], [x1, y0], [x1, y1], [x0, y1], [x0, y0]]
        rows = [{"type": "Feature", "geometry": {"type": "LineString", "coordinates": ring}, "properties": {"id": "bounds"}}]
    return json.dumps({"type": "FeatureCollection", "features": rows})


def outline_feature(points: list[tuple[float, float]]) -> str:
    return json.dumps({"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [[list(p) for p in points]]}, "properties": {}})


def result_json(df: DataFrame) -> DataFrame:
    """Rows as JSON documents."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


# layers of drawings: name, colour index, line weight (fixed values)
LAYERS = {"walls": ("WALLS", 3, 35), "openings": ("OPENINGS", 2, 18), "columns": ("COLUMNS", 1, 35), "mep": ("MEP", 6, 18), "text": ("TEXT", 7, 18), "annotation": ("ANNOTATION", 4, 13)}
UNITS = {"metres": 6, "feet": 2, "inches": 1, "millimetres": 4}


def dxf_line(kind: str, x1: float, y1: float, x2: float, y2: float) -> list[str]:
    """A two-vertex polyline on the layer of its class."""
    out = ["0", "LWPOLYLINE", "8", LAYERS[kind][0], "90", "2", "70", "0"]
    for x, y in ((x1, y1), (x2, y2)):
        out += ["10", repr(float(x)), "20", repr(float(y))]
    return out


def dxf_note(text: str, i: int) -> list[str]:
    return ["0", "TEXT", "8", "ANNOTATION", "10", "0.0", "20", str(-1.0 - i), "40", "0.25", "1", text]


#: what follows the entities of a drawing
DXF_END = ["0", "ENDSEC", "0", "EOF", ""]


def dxf_head(units: str) -> list[str]:
    """What comes before the entities of a drawing: its units and the layers above."""
    out = ["0", "SECTION", "2", "HEADER", "9", "$ACADVER", "1", "AC1032", "9", "$INSUNITS", "70", str(UNITS[units]), "0", "ENDSEC", "0", "SECTION", "2", "TABLES", "0", "TABLE", "2", "LAYER", "70", str(len(LAYERS))]
    for name, colour, weight in LAYERS.values():
        out += ["0", "LAYER", "2", name, "70", "0", "62", str(colour), "6", "CONTINUOUS", "370", str(weight)]
    return [*out, "0", "ENDTAB", "0", "ENDSEC", "0", "SECTION", "2", "ENTITIES"]


def dxf_file(entities: list[str], units: str) -> str:
    """A whole drawing of the layers above and the entities given."""
    return "\n".join([*dxf_head(units), *entities, *DXF_END])


def dxf_text(segments: DataFrame, units: str = "metres", note: str = "") -> tuple[str, list[str]]:
    """A drawing with the layers above and a two-vertex polyline for each row of
    ``segments(class, x1, y1, x2, y2)``; rows of unknown classes are left out and reported. For a plan that
    one file may hold; ``writers`` has the form for more."""
    known = segments.where(F.col("class").isin(*LAYERS))
    dropped = sorted(r[0] for r in segments.where(~F.col("class").isin(*LAYERS)).select("class").distinct().collect())
    out: list[str] = []
    for r in known.orderBy("class", "x1", "y1", "x2", "y2").toLocalIterator():
        out += dxf_line(r["class"], r["x1"], r["y1"], r["x2"], r["y2"])
    for i, text in enumerate([note] * bool(note) + [f"dropped classes: {', '.join(dropped)}"] * bool(dropped)):
        out += dxf_note(text, i)
    return dxf_file(out, units), dropped


def transformed_dxf(segments: DataFrame, matrix: list[list[float]], units: str = "metres") -> str:
    """The drawing with a 4 x 4 matrix applied to its entities and noted on the annotation layer."""
    from ..operators.scalars import transform

    moved = segments
    for i in ("1", "2"):
        x, y, _ = transform(matrix, F.col(f"x{i}").cast("double"), F.col(f"y{i}").cast("double"), F.lit(0.0))
        moved = moved.withColumns({f"_x{i}": x, f"_y{i}": y})
    moved = moved.select("class", *[F.col(f"_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return dxf_text(moved, units, "transform " + json.dumps(matrix))[0]


def annotated_dxf(drawing: str, note: str, layer: str = "ALIGNMENT_NOTE", at: tuple[float, float] = (0.0, 0.0)) -> str:
    """A drawing as it is, with one text more on a layer of its own, at the end of its entities."""
    lines = drawing.splitlines()
    pairs = [(lines[i].strip(), lines[i + 1].strip()) for i in range(0, len(lines) - 1, 2)]
    inside = False
    for i, (code, value) in enumerate(pairs):
        inside = inside or (code, value) == ("2", "ENTITIES")
        if inside and (code, value) == ("0", "ENDSEC"):
            text = ["0", "TEXT", "8", layer, "10", str(at[0]), "20", str(at[1]), "40", "0.25", "1", note]
            return "\n".join([*lines[: 2 * i], *text, *lines[2 * i :]]) + "\n"
    raise ValueError("the drawing has no entities section")


def ply_head(n: int, colours: bool) -> bytes:
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {n}", *[f"property float {k}" for k in "xyz"], *([f"property uchar {c}" for c in ("red", "green", "blue")] if colours else []), "end_header", ""]
    return "\n".join(head).encode()


def ply_bytes(points: DataFrame, target: int = 200_000) -> bytes:
    """Binary PLY of ``points(x, y, z[, r, g, b in 0..1])`` with at most ``target`` vertices, the
    ones of smallest hash of their coordinates; float32, colours truncated to bytes."""
    colours = {"r", "g", "b"} <= set(points.columns)
    rows = points.orderBy(F.xxhash64("x", "y", "z"), "x", "y", "z").limit(target)
    body = bytearray()
    n = 0
    for r in rows.toLocalIterator():
        body += struct.pack("<fff", r["x"], r["y"], r["z"])
        if colours:
            body += bytes(max(0, min(255, int(r[c] * 255))) for c in "rgb")
        n += 1
    return ply_head(n, colours) + bytes(body)


def write_bytes(spark, path: str, body: bytes) -> None:
    """A small file, in any store that Spark can write."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(body))
    finally:
        out.close()


def png_bytes(image) -> bytes:
    """Grey PNG of a uint8 array, first row on top."""
    import zlib

    h, w = image.shape
    raw = b"".join(b"\0" + image[r].tobytes() for r in range(h))
    part = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def overlay_png(cells: DataFrame, segments: DataFrame, affine: dict) -> bytes:
    """A slice in grey with detected lines (world millimetres) over it in white, north up."""
    from ..operators import kernels, raster

    picture, c0, r0 = raster.image(cells.select("col", "row", F.lit(0.5).alias("v")))
    picture, res = picture[::-1].copy(), affine["res"]  # first row south while drawing
    h, w = picture.shape
    at = lambda v, origin, first: int((v - origin) // res) - first
    for s in segments.select("x1", "y1", "x2", "y2").toLocalIterator():
        for c, r in kernels.line_cells(at(s.x1, affine["x0"], c0), at(s.y1, affine["y0"], r0), at(s.x2, affine["x0"], c0), at(s.y2, affine["y0"], r0)):
            if 0 <= c < w and 0 <= r < h:
                picture[r, c] = 255
    return png_bytes(picture[::-1])


def save_slice(cells: DataFrame, affine: dict, folder: str) -> None:
    """A raster slice as a table of cells, its picture (north up) and its affine as JSON, in a folder
    Spark can write."""
    from ..operators import raster

    picture, *_ = raster.image(cells.select("col", "row", F.lit(1.0).alias("v")))
    write_bytes(cells.sparkSession, f"{folder}/slice.png", png_bytes(picture))
    cells.write.mode("overwrite").parquet(f"{folder}/cells")
    cells.sparkSession.createDataFrame([(json.dumps(affine),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/affine")


def load_slice(spark, folder: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{folder}/cells"), json.loads(spark.read.text(f"{folder}/affine").first()[0])
