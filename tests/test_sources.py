import struct

import numpy as np
import pytest

from voxelark.sources import files, ply

XYZ = "pid long, x double, y double, z double"


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_points_and_mesh_round_trip(spark, tmp_path, form):
    p = spark.createDataFrame([(k, k * 0.5, -k * 1.0, 2.0) for k in range(100)], XYZ)
    path = str(tmp_path / "p.ply")
    ply.write_points(path, p, form=form)
    ply.register(spark)
    back = spark.read.format("ply").option("rows", 30).load(path)
    assert [tuple(r) for r in back.orderBy("idx").collect()] == [tuple(r) for r in p.orderBy("pid").collect()]
    f = spark.createDataFrame([(0, [0, 1, 2]), (1, [2, 3, 4, 5])], "fid long, ids array<long>")
    mesh = str(tmp_path / "m.ply")
    ply.write_mesh(mesh, p.withColumnRenamed("pid", "vid"), f, form=form, comments=["two faces"])
    v, g = ply.read_mesh(spark, mesh)
    assert v.count() == 100 and [r["ids"] for r in g.orderBy("fid").collect()] == [[0, 1, 2], [2, 3, 4, 5]]
    assert ply.read_header(mesh).comments == ["two faces"]
    with pytest.raises(ValueError):
        ply.read_envelope(spark, mesh)


def test_unsigned_types_widen(tmp_path, spark):
    path = tmp_path / "u.ply"
    path.write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex 2\nproperty uchar red\nproperty uint n\nend_header\n" + struct.pack("<BIBI", 255, 4_000_000_000, 1, 2))
    ply.register(spark)
    assert [tuple(r) for r in spark.read.format("ply").load(str(path)).orderBy("idx").collect()] == [(0, 255, 4_000_000_000), (1, 1, 2)]


def test_plain_points(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1 2 3 0 0 1\n 4 5 6 0\t1 0 \n\n")
    assert files.read_ascii(spark, str(tmp_path / "a.txt")).count() == 2
    (tmp_path / "b.txt").write_text("1 2 3\n0 0 1 4\n5 6 0 1 0\n")
    assert files.read_ascii_tokens(spark, str(tmp_path / "b.txt")).orderBy("x").collect()[1]["ny"] == 1.0
    p = files.read_ascii(spark, str(tmp_path / "a.txt"))
    files.write_binary(p, str(tmp_path / "c.bnpts"))
    assert sorted(map(tuple, files.read_binary(spark, str(tmp_path / "c.bnpts")).collect())) == sorted(map(tuple, p.collect()))


def test_grid_and_transform(spark, tmp_path):
    g = spark.createDataFrame([(i, j, float(i + 10 * j)) for i in range(4) for j in range(3)], "i int, j int, val double")
    m = np.array([[2.0, 0, 1], [0, 3, 4], [0, 0, 1]])
    files.write_grid(g, str(tmp_path / "g.grid"), (4, 3), m)
    back, resolution, t = files.read_grid(spark, str(tmp_path / "g.grid"))
    assert resolution == (4, 3) and np.allclose(t, m)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, g.collect()))
    (tmp_path / "x.txt").write_text("1 0 0 5 0 1 0 6 0 0 1 7 0 0 0 1")
    assert files.read_transform(str(tmp_path / "x.txt"))[1, 3] == 6


def test_png(spark, tmp_path):
    image = np.random.default_rng(0).integers(0, 256, (5, 7, 3)).astype(np.uint8)
    (tmp_path / "i.png").write_bytes(files.encode_png(image))
    px = files.read_images(spark, str(tmp_path / "i.png"))
    assert px.count() == 35 and px.filter("row = 2 AND col = 3").first()["g"] == image[2, 3, 1]


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    from voxelark.streaming import voxel_counts

    rows = spark.range(200).select((F.col("id") / 200).alias("u"), (F.col("id") % 7 / 7).alias("v"), F.lit(1.0).alias("value"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id")).alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    s = voxel_counts(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 3)
    q = s.writeStream.outputMode("complete").format("memory").queryName("voxels").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = sorted(map(tuple, spark.table("voxels").select("i", "j", "n", "sum").collect()))
    assert got == sorted(map(tuple, voxel_counts(rows, 3).select("i", "j", "n", "sum").collect()))


def test_packed_points_in_tasks(spark, tmp_path, monkeypatch):
    """Rows are packed and read by tasks, in order, not one at a time on the driver or a file a task."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(type(spark.range(1)), "toLocalIterator", None)
    n = (1 << 18) + 5
    p = spark.range(0, n, 1, 3).select(*((F.col("id") / k).alias(c) for k, c in enumerate(files.POINT, 1)))
    files.write_binary(p, str(tmp_path / "p.bnpts"))
    want = (np.arange(n)[:, None] / np.arange(1, 7)).astype("<f4")
    assert (tmp_path / "p.bnpts").read_bytes() == want.tobytes()
    back = files.read_binary(spark, str(tmp_path / "p.bnpts"))
    assert back.select(F.spark_partition_id()).distinct().count() == 2
    assert (back.toPandas().to_numpy() == want).all()


def test_packed_points_of_odd_kinds(spark, tmp_path):
    six = ", ".join(f"{c} double" for c in files.POINT)
    files.write_binary(spark.createDataFrame([], six), str(tmp_path / "none.bnpts"))
    assert files.read_binary(spark, str(tmp_path / "none.bnpts")).count() == 0
    for bad in (None, 1e300):
        with pytest.raises(Exception, match="a point has a null|overflow"):
            files.write_binary(spark.createDataFrame([(1.0, 2.0, 3.0, 0.0, 0.0, bad)], six), str(tmp_path / "bad.bnpts"))
    (tmp_path / "cut.bnpts").write_bytes(b"\0" * 25)
    with pytest.raises(Exception, match="multiple of element size"):
        files.read_binary(spark, str(tmp_path / "cut.bnpts")).collect()


def test_packed_points_of_a_store_that_only_spark_reads(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.packed.link./in", f"file://{tmp_path}")
    (tmp_path / "a, b c.bnpts").write_bytes(np.arange(600_000, dtype="<f4").tobytes())
    back = files.read_binary(spark, "viewfs://packed/in/a, b c.bnpts").toPandas().to_numpy()
    assert (np.sort(back.ravel()) == np.arange(600_000)).all() and back.shape == (100_000, 6)
