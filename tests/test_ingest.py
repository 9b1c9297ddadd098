"""Ingest of files that the test writes: headers, rejects, parts that are run again, and a store looked up by position."""

import os
import struct

import pytest
from pyspark.sql import functions as F

from inkstone.sources import ingest, samples, store

from .test_pixels import picture, png

PNG = png(picture(5, 7))
GIF = b"GIF89a" + struct.pack("<HH", 9, 4) + b"\0\0\0" + b"x" * 20 + b";"
BMP = b"BM" + struct.pack("<IHHIIii", 60, 0, 0, 54, 40, 3, -2) + b"\0" * 34
JPEG = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"\0" * 14 + b"\xff\xc4" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc2" + struct.pack(">HBHHB", 11, 8, 21, 33, 1) + b"\0\0\0\xff\xda\0\x02data\xff\xd9"
FAR = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 65535) + b"\0" * 65533) * 3 + JPEG[2:]
CASES = {
    "a.png": (PNG, ("png", 7, 5, None)),
    "b.gif": (GIF, ("gif", 9, 4, None)),
    "c.bmp": (BMP, ("bmp", 3, 2, None)),
    "d.jpg": (JPEG, ("jpeg", 33, 21, None)),
    "e.jpg": (FAR, ("jpeg", 33, 21, None)),
    "f.png": (PNG[:40], ("png", 7, 5, "ends early")),
    "g.png": (PNG[:15], ("png", None, None, "no size")),
    "h.gif": (GIF.replace(struct.pack("<HH", 9, 4), struct.pack("<HH", 0, 4)), ("gif", 0, 4, "no area")),
    "i.jpg": (JPEG[:-2], ("jpeg", 33, 21, "ends early")),
    "j.jpg": (FAR[:70000], ("jpeg", None, None, "no size")),
    "k.bmp": (BMP[:50], ("bmp", 3, 2, "ends early")),
    "l.txt": (b"no image at all", (None, None, None, "no image")),
    "m.png": (b"", (None, None, None, "empty file")),
}


@pytest.fixture
def tree(tmp_path):
    (tmp_path / "img").mkdir()
    for name, (data, _) in CASES.items():
        (tmp_path / "img" / name).write_bytes(data)
    # Whoever opens this one waits for ever.
    os.mkfifo(tmp_path / "img" / "unwanted.png")
    return tmp_path


def test_headers(spark, tree):
    want = {n: r for n, (_, r) in CASES.items()} | {"away.png": (None, None, None, "no file"), "": (None, None, None, "no file")}
    rows = spark.createDataFrame([(n, f"{tree}/img/{n}" if n else None) for n in want], "name string, path string").repartition(3)
    got = {r["name"]: tuple(r["header"]) for r in ingest.inspected(rows).collect()}
    assert got == want
    read = ingest.with_header(ingest.fetched(rows, name="content"))
    got = {r["name"]: (r["content"], tuple(r["header"])) for r in read.collect()}
    assert got == {n: (bytearray(CASES[n][0]) if n in CASES else None, r) for n, r in want.items()}
    assert ingest.fetched(rows.limit(0)).collect() == [] and ingest.inspected(rows.limit(0)).collect() == []


def test_every_cut_of_a_header_is_told(spark):
    for data, (kind, width, height, _) in (CASES[n] for n in ("a.png", "b.gif", "c.bmp", "d.jpg")):
        for n in range(len(data)):
            found = ingest.image_header(data[:n], data[:n], n)
            assert found[3] is not None and found[:3] in ((None, None, None), (kind, None, None), (kind, width, height))


LISTS = {"1.tsv": "a.png\tone\nbad line\nb.gif\ttwo\n", "2.tsv": "f.png\tcut\nd.jpg\t\naway.png\tx\na.png\tone again\n", "3.tsv": "l.txt\tx\ne.jpg\tfar\n"}


def test_lists_keep_their_order(spark, tmp_path):
    want = []
    for name in ("b", "a", "c"):
        lines = [f"{name}{i:05}.png\tlabel {i}" for i in range(4000 if name == "a" else 30)]
        (tmp_path / f"{name}.tsv").write_text("\n".join(lines) + "\n")
    for name in ("a", "b", "c"):
        want += (tmp_path / f"{name}.tsv").read_text().split("\n")[:-1]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    for size in ("20000", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = samples.list_lines(spark, str(tmp_path)).orderBy("line").collect()
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        assert [(r["line"], r["value"]) for r in got] == list(enumerate(want, 1))


def test_one_part(spark, tree):
    lines = spark.createDataFrame(list(enumerate("".join(LISTS.values()).split("\n")[:-1])), "line long, value string").repartition(4)
    out = ingest.write_parts(lines, f"{tree}/img", f"{tree}/out", 0, 0)
    got = [(r["idx"], r["label"], bytes(r["image"])) for r in ingest.committed(spark, f"{tree}/out").orderBy("idx").collect()]
    assert got == [(1, "one", PNG), (2, "two", GIF), (3, "", JPEG), (4, "one again", PNG), (5, "far", FAR)]
    rejects = [tuple(r) for r in ingest.committed(spark, f"{tree}/out", "rejects").orderBy("line").collect()]
    assert rejects == [(1, "bad line", "not two fields"), (3, "f.png\tcut", "ends early"), (5, "away.png\tx", "no file"), (7, "l.txt\tx", "no image")]
    assert (out["n"], out["rejects"], out["bytes"]) == (5, 4, sum(len(x[2]) for x in got)) and out["seconds"] > 0
    assert tuple(ingest.counts(spark, f"{tree}/out").select("part", "before", "n", "rejects").first()) == (0, 0, 5, 4)


def run(spark, tree):
    query = ingest.ingest_stream(spark, f"{tree}/lists", f"{tree}/img", f"{tree}/out").trigger(availableNow=True).start()
    try:
        query.awaitTermination(120)
    finally:
        query.stop()


def state(spark, tree):
    return [(r["idx"], r["label"]) for r in ingest.committed(spark, f"{tree}/out").orderBy("idx").collect()]


def test_parts_go_on_and_are_run_again(spark, tree, monkeypatch):
    (tree / "lists").mkdir()
    assert ingest.counts(spark, f"{tree}/out").collect() == []
    (tree / "lists" / "1.tsv").write_text(LISTS["1.tsv"])
    run(spark, tree)
    assert state(spark, tree) == [(1, "one"), (2, "two")]
    # Stopped behind the samples and before the count: nothing of the part shows.
    (tree / "lists" / "2.tsv").write_text(LISTS["2.tsv"])
    with monkeypatch.context() as m:
        m.setattr(ingest, "commit", None)
        with pytest.raises(Exception):
            run(spark, tree)
    assert state(spark, tree) == [(1, "one"), (2, "two")] and (tree / "out" / "samples" / "part=1").exists()
    (tree / "lists" / "3.tsv").write_text(LISTS["3.tsv"])
    run(spark, tree)
    want = [(1, "one"), (2, "two"), (3, ""), (4, "one again"), (5, "far")]
    assert state(spark, tree) == want
    run(spark, tree)
    assert state(spark, tree) == want
    assert sorted((r["value"], r["reason"]) for r in ingest.committed(spark, f"{tree}/out", "rejects").collect()) == [("away.png\tx", "no file"), ("bad line", "not two fields"), ("f.png\tcut", "ends early"), ("l.txt\tx", "no image")]
    # A part written anew is the same part.
    before = ingest.counts(spark, f"{tree}/out").filter("part = 1").first()
    lines = spark.createDataFrame(list(enumerate(LISTS["2.tsv"].split("\n")[:-1])), "line long, value string")
    again = ingest.write_parts(lines, f"{tree}/img", f"{tree}/out", 1, before["before"])
    assert again["n"] == before["n"] and state(spark, tree) == want


def opened(df):
    return [f for f in df.inputFiles() if "/samples/" in f]


def test_store_opens_only_what_is_asked_for(spark, tmp_path):
    rows = spark.range(1, 2001).select(F.col("id").alias("idx"), F.concat(F.lit("l"), F.col("id") % 3).alias("label"), F.col("id").cast("string").cast("binary").alias("image"))
    store.write_store(rows, f"{tmp_path}/s", files=8)
    store.write_index(spark, f"{tmp_path}/s", "ones", "label = 'l1'")
    every = spark.read.parquet(f"{tmp_path}/s/samples").inputFiles()
    at = spark.createDataFrame([(5,), (6,), (6,), (0,), (5000,), (None,)], "position long")
    got = store.stored(spark, f"{tmp_path}/s", at)
    assert len(every) == 8 and len(opened(got)) == 1
    assert [(r["position"], r["idx"], bytes(r["image"])) for r in got.orderBy("position").collect()] == [(5, 5, b"5"), (6, 6, b"6")]
    at = spark.createDataFrame([(1,), (667,)], "position long")
    got = store.stored(spark, f"{tmp_path}/s", at, "ones")
    assert len(opened(got)) == 2 and [(r["position"], r["idx"], r["label"]) for r in got.orderBy("position").collect()] == [(1, 1, "l1"), (667, 1999, "l1")]
    every = store.stored(spark, f"{tmp_path}/s", spark.range(1, 2001).withColumnRenamed("id", "position"), "ones")
    want = [tuple(r) for r in samples.lookup(rows, spark.range(1, 2001).withColumnRenamed("id", "position"), F.col("label") == "l1").select("position", "idx").orderBy("position").collect()]
    assert [(r["position"], r["idx"]) for r in every.orderBy("position").collect()] == want
    assert store.stored(spark, f"{tmp_path}/s", at.limit(0)).collect() == []
