"""Queries that write files under the shared folder and read them back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from ..sources import files, ply
from ..storage import folder
from . import apps
from .data import AXES3, P, points, q, quant
from .field_queries import _G, W, grid
from .mesh_queries import _M, mesh

_SIX = (*AXES3, "nx", "ny", "nz")
_F4 = lambda c: f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


def _place(spark: SparkSession, name: str) -> tuple[str, str]:
    """(address, the same as a plain path) of a new file whose folder is there."""
    import os
    from urllib.parse import urlparse

    at = folder(spark)
    plain = urlparse(at).path
    os.makedirs(plain, exist_ok=True)
    return f"{at}/{name}", f"{plain}/{name}"


def _sums(t: DataFrame) -> DataFrame:
    return t.agg(F.count(F.lit(1)).alias("n"), *(quant(F.avg(c), 3).alias(c) for c in _SIX))


def _sums_sql(of: str) -> str:
    return f"WITH {P} SELECT count(*) n, {', '.join(q('avg(' + of.format(c=c) + ')', 3) + ' ' + c for c in _SIX)} FROM p"


@query(_sums_sql("{c}"))
def ascii_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _ = _place(spark, "points")
    files.write_ascii(points(spark, sf_dir), at)
    return _sums(files.read_ascii(spark, at))


@query(_sums_sql(_F4("{c}")))
def binary_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, plain = _place(spark, "points.bnpts")
    files.write_binary(points(spark, sf_dir), plain)
    return _sums(files.read_binary(spark, at))


@query(_sums_sql(_F4("{c}")))
def ply_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _ = _place(spark, "points.ply")
    ply.write_points(at, points(spark, sf_dir).select("pid", *_SIX))
    ply.register(spark)
    return _sums(spark.read.format("ply").load(at))


@query(f"WITH {_M} SELECT fid, ids[1] a, ids[3] c, {q(_F4('v.z'))} z FROM f JOIN v ON v.vid = ids[1]")
def ply_mesh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mesh through a file: faces with their first corner's height."""
    at, _ = _place(spark, "mesh.ply")
    ply.write_mesh(at, *mesh(spark, sf_dir), comments=["a grid"])
    v, f = ply.read_mesh(spark, at)
    f = f.select("fid", F.col("ids")[0].alias("a"), F.col("ids")[2].alias("c"))
    return f.join(v.select(F.col("vid").alias("a"), "z"), "a").select("fid", "a", "c", quant(F.col("z").cast("double")).alias("z"))


@query(f"WITH {_M}, e AS (SELECT DISTINCT least(a, b) a, greatest(a, b) b FROM h) SELECT a, b FROM e")
def ply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.mesh import edges
    from ..operators.points import row_numbers

    at, _ = _place(spark, "curve.ply")
    v, f = mesh(spark, sf_dir)
    ply.write_curve(at, v, row_numbers(edges(f), ["a", "b"], "eid"))
    ply.register(spark)
    return spark.read.format("ply").option("element", "edge").load(at).select(F.col("v1").cast("long").alias("a"), F.col("v2").cast("long").alias("b"))


@query("SELECT * FROM (VALUES ('vertex', 576, 'x,y,z,value'), ('face', 529, 'vertex_indices')) t(element, n, properties)")
def ply_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a header tells of a file's elements."""
    at, _ = _place(spark, "mesh.ply")
    ply.write_mesh(at, *mesh(spark, sf_dir))
    head = ply.read_header(at)
    return spark.createDataFrame([(e.name, e.count, ",".join(p[0] for p in e.properties)) for e in head.elements], "element string, n int, properties string")


@query(f"WITH {_G} SELECT i, j, {q(_F4('val'))} val FROM g")
def grid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, plain = _place(spark, "field.grid")
    files.write_grid(grid(spark, sf_dir), plain, (W, W), np.eye(3))
    back, resolution, _ = files.read_grid(spark, plain)
    assert resolution == (W, W)
    return back.select("i", "j", quant(F.col("val")).alias("val"))


@query(f"WITH {_G}, t AS (SELECT avg(val) m, stddev_pop(val) d FROM g) SELECT i AS \"row\", j AS col, CAST(floor((greatest(-1.0, least(1.0, (val - m) / (2 * d))) + 1) / 2 * 255) AS INTEGER) AS grey FROM g, t")
def image_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid as a grey image and back."""
    from ..operators.fem import grey

    at, plain = _place(spark, "field.png")
    t = grey(grid(spark, sf_dir)).select("i", "j", F.floor("grey").cast("int").alias("grey")).toPandas()  # an image of W x W
    image = np.zeros((W, W, 1), dtype=np.uint8)
    image[t["i"], t["j"], 0] = t["grey"]
    with open(plain, "wb") as f:
        f.write(files.encode_png(image))
    return files.read_images(spark, at).select("row", "col", F.col("r").alias("grey"))


@query("SELECT CAST(n // 4 AS INTEGER) AS \"row\", CAST(n % 4 AS INTEGER) AS col, n * 0.5::DOUBLE AS val FROM range(16) t(n)")
def transform_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, plain = _place(spark, "transform.txt")
    with open(plain, "w") as f:
        f.write("\n".join(" ".join(str((4 * r + c) / 2) for c in range(4)) for r in range(4)))
    m = files.read_transform(plain)
    return spark.createDataFrame([(r, c, float(m[r, c])) for r in range(4) for c in range(4)], "row int, col int, val double")


@query(f"""WITH {P}, c AS (SELECT CAST(floor(x / 20) AS INTEGER) cx, CAST(floor(y / 40000) AS INTEGER) cy FROM p) SELECT cx, cy, count(*) n FROM c GROUP BY 1, 2""")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder for each chunk, found again by its name."""
    from ..operators.mesh import chunks

    at, _ = _place(spark, "chunks")
    p = points(spark, sf_dir).select("pid", (F.col("x") + 1e-9).alias("x"), (F.col("y") / 2000 + 1e-9).alias("y"))
    files.write_chunks(chunks(p, 20.0, 0.0, ("x", "y")), at, ("cx", "cy"))
    return spark.read.parquet(at).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P} SELECT CAST(pid % 6 AS INTEGER) slab, count(*) n, {q('sum(a)')} a FROM p GROUP BY 1")
def slab_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, _ = _place(spark, "slabs")
    files.write_slabs(points(spark, sf_dir).select("pid", "a", (F.col("pid") % 6).cast("int").alias("slab")), at)
    return spark.read.parquet(at).groupBy("slab").agg(F.count(F.lit(1)).alias("n"), quant(F.sum("a")).alias("a"))


@query("SELECT 3 AS base, 3 AS depth, 729::BIGINT AS corners, true AS same, true AS dense")
def implicit_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A solved field saved and loaded: it has the same value where it is read, and its density."""
    im = apps.poisson(apps.sphere(spark, 500), 3, 3)
    at, _ = _place(spark, "field")
    im.save(spark, at)
    back = apps.Implicit.load(spark, at)
    p = spark.createDataFrame([(0, 0.1, 0.2, 0.3)], "p int, x double, y double, z double")
    a, b = (float(f.evaluate(p, "p").first()["value"]) for f in (im, back))
    return spark.createDataFrame([(back.base, back.depth, back.field.count(), abs(a - b) < 1e-12 and back.level == im.level, back.density is not None)], "base int, depth int, corners long, same boolean, dense boolean")


@query(f"WITH {P} SELECT count(*) n, {q('sum(y)', 1)} y FROM p")
def sampled_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with a value, a line each, as text."""
    at, _ = _place(spark, "values")
    files.write_values(points(spark, sf_dir), at, AXES3, "a")
    t = files.read_ascii(spark, at, (*AXES3, "value"))
    return t.agg(F.count(F.lit(1)).alias("n"), quant(F.sum("y"), 1).alias("y"))
