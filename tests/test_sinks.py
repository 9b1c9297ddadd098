"""Exports, records read back, report order, run logs and single images."""

from pyspark.sql import functions as F

from inkstone.functions import codecs
from inkstone.operators import sampling
from inkstone.sources import pixels, samples

from .test_pixels import picture, png


def test_records_and_back(spark):
    rows = spark.createDataFrame([(1, "a", b"x"), (2, "", None), (1_234_567_890, "é", b"")], "idx long, label string, image binary")
    records = samples.key_values(rows)
    got = sorted(tuple(r) for r in samples.from_key_values(records.repartition(5)).collect())
    assert got == [(1, "a", bytearray(b"x")), (2, "", None), (1_234_567_890, "é", bytearray(b""))]
    lone = spark.createDataFrame([("label-000000007", b"q"), ("num-samples", b"1"), ("image-7", b"z"), ("other", b"")], "key string, value binary")
    assert [tuple(r) for r in samples.from_key_values(lone).collect()] == [(7, "q", None)] and samples.from_key_values(lone.limit(0)).collect() == []


def test_exported_images(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"l{i}", png(picture(2, 3, seed=i)) if i != 3 else None) for i in range(1, 6)], "idx long, label string, image binary").repartition(3)
    assert samples.export_images(rows, f"{tmp_path}/out", ".png") == 4 and samples.export_images(rows, f"{tmp_path}/out", ".png") == 4
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == [f"image-00000000{i}.png" for i in (1, 2, 4, 5)]
    assert (tmp_path / "out" / "image-000000002.png").read_bytes() == png(picture(2, 3, seed=2))


def test_single_image_and_valid_images(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(picture(4, 6)))
    (tmp_path / "b.png").write_bytes(b"junk")
    row = pixels.decoded(spark, str(tmp_path / "a.png")).first()
    assert (row["height"], row["width"], row["channels"], bytes(row["pixels"])) == (4, 6, 1, picture(4, 6).tobytes())
    assert [(r["path"], r["width"], r["height"]) for r in samples.valid_images(spark, str(tmp_path)).collect()] == [(f"{tmp_path}/a.png", 6, 4)]


def test_report_order(spark, tmp_path):
    report = spark.createDataFrame([("a", 50.0), ("z", 50.0), ("b", 50.0), ("c", 90.0), ("q", None), ("?", 50.0)], "ch string, accuracy double")
    vocab = spark.createDataFrame([("z", 1), ("b", 2), ("a", 3), ("c", 4)], "ch string, id int")
    assert [r["ch"] for r in samples.ranked(report).collect()] == ["c", "?", "a", "b", "z"]
    assert [r["ch"] for r in samples.ranked(report, vocab).collect()] == ["c", "z", "b", "a", "?"]
    samples.write_report(report, f"{tmp_path}/r", vocab)
    assert [r["Alphabet"] for r in samples.read_report(spark, f"{tmp_path}/r").collect()] == ["c", "z", "b", "a", "?"]


def test_logs_and_rejects(spark, tmp_path):
    samples.write_log(spark, f"{tmp_path}/log", "epoch", 1, 0.5, stamp="2024-01-01_00-00-00")
    samples.write_log(spark, f"{tmp_path}/log", "done")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/log").collect()) == ["2024-01-01_00-00-00", "done", "epoch 1 0.5"]
    rejects = spark.createDataFrame([(1, "x", "no file")], "line long, value string, reason string")
    for _ in range(2):
        samples.write_rejects(rejects, f"{tmp_path}/rejects")
    assert [tuple(r) for r in spark.read.schema(rejects.schema).json(f"{tmp_path}/rejects").collect()] == [(1, "x", "no file")] * 2


def test_flat_vector_is_one_vector(spark):
    texts = ["abc", "", "ca", None, "bb?", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(4)
    rows = sampling.flat_vector(df, "k", "s", "abc").orderBy("k").collect()
    vector = [i for r in rows for i in r["ids"] or []]
    assert vector == [1, 2, 3, 3, 1, 2, 2, 0, 1] and [(r["offset"], r["length"]) for r in rows] == [(0, 3), (3, 0), (3, 2), (5, 0), (5, 3), (8, 1)]
    whole = spark.createDataFrame([(vector, r["offset"], r["length"], r["s"]) for r in rows if r["s"] in ("abc", "ca", "a")], "v array<int>, o int, n int, s string")
    assert all(r[0] == r[1] for r in whole.select(codecs.flat_decode(F.col("v"), F.col("o"), F.col("n"), "abc"), "s").collect())


def test_option_lists(spark):
    assert spark.createDataFrame([("MJ-ST",), ("/",), ("",), (None,)], "s string").select(samples.option_list(F.col("s"))).collect() == [(["MJ", "ST"],), (["/"],), ([""],), (None,)]
