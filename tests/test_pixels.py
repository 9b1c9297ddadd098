"""Pixels: decoding of files that the test writes, exact values, and filters against direct sums."""

import itertools
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.operators import augmentation
from inkstone.plans import catalog
from inkstone.sources import pixels

SCHEMA = "idx long, height int, width int, channels int, pixels binary"


def png(x):
    """An image array as a PNG file."""
    h, w, c = x.shape
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + r.tobytes() for r in x))) + chunk(b"IEND", b"")


def picture(h, w, c=1, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, c), np.uint8)


def rows(spark, *images):
    return spark.createDataFrame([(i, *x.shape, x.tobytes()) if x is not None else (i, None, None, None, None) for i, x in enumerate(images)], SCHEMA)


def arrays(df, order="idx"):
    return [r["pixels"] and np.frombuffer(r["pixels"], np.uint8).reshape(r["height"], r["width"], r["channels"]) for r in df.orderBy(order).collect()]


def test_decoding(spark, tmp_path):
    grey, colour, clear = picture(5, 7), picture(3, 4, 3, 1), picture(2, 2, 4, 2)
    for name, data in (("a.png", png(grey)), ("b.png", png(colour)), ("c.png", png(clear)), ("d.png", b"no image"), ("e.png", png(grey)[:30])):
        (tmp_path / name).write_bytes(data)
    df = pixels.decoded(spark, str(tmp_path))
    got = {r["path"].rpartition("/")[2]: r for r in df.collect()}
    assert len(got) == 5 and got["d.png"]["pixels"] is None and got["e.png"]["height"] is None
    a, b, c, d, e = arrays(df, "path")
    assert (a == grey).all() and (b == colour).all() and (c == clear[:, :, :3]).all()
    a, b, *_ = arrays(pixels.mirrored(df), "path")
    assert (a == grey[:, ::-1]).all() and (b == colour[:, ::-1]).all()
    a, b, *_ = arrays(pixels.grey(df), "path")
    want = [[(19595 * int(r) + 38470 * int(g) + 7471 * int(u) + 32768) >> 16 for r, g, u in row] for row in colour]
    assert (a == grey).all() and b[:, :, 0].tolist() == want


def kernel(x):
    x = abs(x)
    return 1.5 * x**3 - 2.5 * x**2 + 1 if x < 1 else -0.5 * x**3 + 2.5 * x**2 - 4 * x + 2 if x < 2 else 0.0


def direct(x, height, width):
    """Every output pixel as a sum over all input pixels."""
    out = np.zeros((height, width, x.shape[2]))
    for i, j in itertools.product(range(height), range(width)):
        total = 0.0
        for y, z in itertools.product(range(x.shape[0]), range(x.shape[1])):
            sy, sx = x.shape[0] / height, x.shape[1] / width
            w = kernel((y + 0.5 - (i + 0.5) * sy) / max(sy, 1)) * kernel((z + 0.5 - (j + 0.5) * sx) / max(sx, 1))
            out[i, j] += w * x[y, z]
            total += w
        out[i, j] /= total
    return out


@pytest.mark.parametrize("h, w, to", [(4, 6, (9, 13)), (9, 12, (4, 5)), (5, 7, (5, 7)), (1, 1, (3, 2)), (6, 3, (2, 9)), (20, 3, (1, 1))])
def test_resampling_is_the_direct_sum(h, w, to):
    x = picture(h, w, 2)
    assert np.abs(pixels.resampled(x, *to) - direct(x, *to)).max() < 1e-6


def test_resizing(spark):
    x, y = picture(10, 20), picture(8, 4, 3, 1)
    got = arrays(pixels.resized(rows(spark, x, None, y), 6, 9))
    assert got[1] is None and all((a == np.clip(np.floor(direct(b, 6, 9) + 0.5), 0, 255)).all() for a, b in ((got[0], x), (got[2], y)))
    assert [a.shape for a in arrays(pixels.kept_ratio(rows(spark, x, y, picture(2, 90)), 5, 30))] == [(5, 10, 1), (5, 3, 3), (5, 30, 1)]


#: Pixels of which one comes to a half at 5 by 12, where the order of the sum decides.
HALVES = (
    "312b232624352f292f32262f3930274739373735412e343f453b3f3c4b48514e4e4a4c4a4448553e545a514e515b58516259415569556065666a5e5264685b67",
    "63769a90a499b2bcc3c6d9cbe4eceefc000d0e301f37474d4b5e62677c788f90879ca6afbebfcbdddee3f5fa0c2127182235383d5151516e6e7a8a88939aa1b8",
    "f5f9fff7010200fe01f5fe04fb0b00fbfefe0dfbf0030819040bfbf8fef7050304f30efa0001fefd12fb05040109f606080502fd1209010a030408f5f903fbfa",
    "b8c9b7d5ccd7d0d9d4d9d9cdd9e9f0eae8fdecf6f804fc04fbfb061b04181219191d22262e323a344039383f3e4046504f4f505362676a576e70726178656f6b",
)


def test_halves_are_rounded_as_the_sql_rounds_them(spark, tmp_path):
    # On a handful of rows DuckDB joins, and sums, in another order than on tables.
    vectors = [(i, [b / 64 for b in bytes.fromhex(x)]) for i, x in enumerate(10 * HALVES)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = catalog.QUERIES["bicubic_resize"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(catalog.ORACLE["bicubic_resize"]).fetchall())


def test_model_input(spark):
    x, y = picture(4, 4), picture(4, 30, 3, 2)
    got = [r["input"] for r in pixels.model_input(rows(spark, x, None, y), 4, 12).orderBy("idx").collect()]
    a = np.array(got[0]).reshape(1, 4, 12)
    assert got[1] is None and np.allclose(a[0, :, :4], x[:, :, 0] / 127.5 - 1, atol=1e-6) and (a[0, :, 4:] == a[0, :, 3:4]).all()
    assert len(got[2]) == 3 * 4 * 12 and -1 <= min(got[2]) and max(got[2]) <= 1
    fixed = pixels.model_input(rows(spark, x), 6, 9, keep_ratio=False).first()
    assert len(fixed["input"]) == 54 and fixed["width"] == 9


def test_schedule_is_the_same_everywhere_and_even(spark):
    ids = spark.range(6000)
    plan = lambda df, epoch=1, seed=0: df.select("id", augmentation.schedule(F.col("id"), epoch, seed).alias("ops"))
    one = {r["id"]: tuple(o["op"] for o in r["ops"]) for r in plan(ids.repartition(1)).collect()}
    assert one == {r["id"]: tuple(o["op"] for o in r["ops"]) for r in plan(ids.repartition(16)).collect()}
    assert all(len(set(o)) == 3 for o in one.values())
    other = {r["id"]: tuple(o["op"] for o in r["ops"]) for r in plan(ids, 2).collect()}
    assert sum(one[i] == other[i] for i in one) < 60
    for place in range(3):
        n = np.unique([o[place] for o in one.values()], return_counts=True)[1]
        assert len(n) == 8 and abs(n / 750 - 1).max() < 0.15
    row = plan(ids, 1).filter("id = 3").first()["ops"][0]
    assert row["argument"] == augmentation.FULL[row["op"]] / 2
    u = [r[0] for r in ids.select(augmentation.drawn(1, 2, F.col("id"), "x")).collect()]
    assert 0 <= min(u) and max(u) < 1 and abs(np.mean(u) - 0.5) < 0.02


def test_blurs_are_direct_sums():
    x, rng = picture(9, 120, 1, 4), augmentation.stream(0)
    radius = augmentation.limited(2.0, x, 0.02)
    at = range(-3 * radius, 3 * radius + 1)
    k = np.array([[np.exp(-(a * a + b * b) / (2 * radius**2)) for b in at] for a in at])
    k /= k.sum()
    got = augmentation.gaussian_blur(x, 2.0, rng)
    for i, j in ((0, 0), (4, 60), (8, 119), (3, 1)):
        want = sum(k[a + 3 * radius, b + 3 * radius] * float(x[min(max(i + a, 0), 8), min(max(j + b, 0), 119), 0]) for a in at for b in at)
        assert got[i, j, 0] == pytest.approx(want)
    size = augmentation.limited(10.0, x, 0.08, 3, odd=True)
    assert size % 2 == 1 and augmentation.motion_blur(x, 10.0, rng)[2, 50, 0] == pytest.approx(x[2, 50 - size // 2 : 51 + size // 2, 0].mean())


def test_noise_has_the_right_sizes():
    x = np.full((200, 300, 1), 128, np.uint8)
    g = augmentation.gaussian_noise(x, 12.75, augmentation.stream(1)) - 128.0
    assert abs(g.mean()) < 0.2 and abs(g.std() - 13) < 0.2
    p = augmentation.poisson_noise(x, 20.0, augmentation.stream(2)) - 128.0
    assert abs(np.abs(p).mean() - 21) < 0.2 and abs(p.mean()) < 0.3
    s = augmentation.salt_and_pepper(x, 0.05, augmentation.stream(3))
    assert abs((s == 0).mean() - 0.025) < 0.003 and abs((s == 255).mean() - 0.025) < 0.003 and set(np.unique(s)) == {0, 128, 255}
    assert (augmentation.invert(x, 0, None) == 127).all()
    for k in range(50):
        c = augmentation.border_crop(x, 0, augmentation.stream(k))
        r = augmentation.random_resize(x[:40, :60], 0, augmentation.stream(k))
        assert 170 <= c.shape[0] <= 200 and 285 <= c.shape[1] <= 300 and 1 <= r.shape[0] <= 60 and 1 <= r.shape[1] <= 90
    assert augmentation.border_crop(x[:1, :1], 0, augmentation.stream(0)).shape == (1, 1, 1)


def test_augmentation_does_not_depend_on_partitions(spark):
    df = rows(spark, *(picture(12, 20, 1 + 2 * (k % 2), k) if k != 5 else None for k in range(24)))
    one, many, again = ({r["idx"]: (r["height"], r["width"], r["pixels"], r["ops"]) for r in augmentation.augmented(d, "idx", epoch).collect()} for d, epoch in ((df.repartition(1), 3), (df.repartition(16), 3), (df, 4)))
    assert one == many and one != again and one[5][2] is None
    assert all(len(v[2]) == v[0] * v[1] * (1 + 2 * (i % 2)) for i, v in one.items() if i != 5)
    with pytest.raises(ValueError, match="Nothing"):
        augmentation.augmented(df, "idx", 1, names=("Nothing",))


def test_augmented_query_reads_every_vector(spark):
    from inkstone.plans import catalog

    from .conftest import SMALL

    got = catalog.QUERIES["augment_pixels"](spark, SMALL).collect()
    again = catalog.QUERIES["augment_pixels"](spark, SMALL).collect()
    assert len(got) == catalog.table(spark, SMALL, "embeddings").count() and sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert all(len(r["pixels"]) == 2 * r["height"] * r["width"] for r in got) and len({(r["height"], r["width"]) for r in got}) > 3
