"""Pixels of images as rows: decoding, grey, mirroring, bicubic resizing and a recogniser's input.

An image is ``height``, ``width``, ``channels`` and ``pixels``: bytes row by row, the channels of a pixel (grey, or red, green, blue) side by side. What does not decode has null in all four and stays so. Images differ in size, so each is an array of its own inside an Arrow batch; Spark deals the batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring

FIELDS = ("height", "width", "channels", "pixels")
#: Grey as the ITU-R 601 weights of red, green and blue, in 65,536ths.
GREY = np.array([19595, 38470, 7471])


def decoded(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, pixels) of the files below a folder, by Spark's own image reader; null but for the path where a file is no image. A fourth channel, opacity, goes."""
    files = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    good = (F.col("image.width") > 0) & (F.col("image.height") > 0)
    found = {"height": "image.height", "width": "image.width", "channels": "image.nChannels", "pixels": "image.data"}
    rows = files.select(F.regexp_replace("image.origin", "^[a-z]+:(//)?", "").alias("path"), *(F.when(good, F.col(c)).alias(n) for n, c in found.items()))
    # The reader gives blue, green, red.
    return each_image(rows, lambda x, _: x[:, :, 2::-1] if x.shape[2] >= 3 else x)


def each_image(rows: DataFrame, change: Callable[[np.ndarray, dict], np.ndarray], *beside: str) -> DataFrame:
    """``rows`` with every image replaced by ``change`` of its array (height, width, channel) and the row's values of the columns ``beside``; images that are null stay null. Values are rounded half up and cut to bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = {n: batch[n].to_pylist() for n in (*FIELDS, *beside)}
            out = {n: [] for n in FIELDS}
            for i in range(batch.num_rows):
                h, w, c, data = (own[n][i] for n in FIELDS)
                x = None
                if data is not None and h and w and c:
                    x = change(np.frombuffer(data, np.uint8).reshape(h, w, c), {n: own[n][i] for n in beside})
                    if x.dtype != np.uint8:
                        x = np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
                for n, v in zip(FIELDS, (None,) * 4 if x is None else (*x.shape, x.tobytes()), strict=True):
                    out[n].append(v)
            kinds = {"pixels": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array(out[n], kinds.get(n, pa.int32())) if n in out else batch[n] for n in batch.schema.names], batch.schema.names)

    kinds = {n: T.IntegerType() for n in FIELDS[:3]} | {"pixels": T.BinaryType()}
    return rows.mapInArrow(work, T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType)) for f in rows.schema]))


def grey(rows: DataFrame) -> DataFrame:
    """Images of three channels as one; grey ones as they are."""
    return each_image(rows, lambda x, _: ((x[:, :, :3].astype(np.int64) @ GREY + 0x8000) >> 16).astype(np.uint8)[:, :, None] if x.shape[2] >= 3 else x)


def mirrored(rows: DataFrame) -> DataFrame:
    """Each row of pixels from right to left, as scripts written so are read."""
    return each_image(rows, lambda x, _: x[:, ::-1])


def cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    """The bicubic kernel, 0 from a distance of 2 on."""
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x * x * x - (a + 3) * x * x + 1, np.where(x < 2, a * x * x * x - 5 * a * x * x + 8 * a * x - 4 * a, 0.0))


@lru_cache(maxsize=256)
def taps(size: int, to: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of ``to`` places, the places of a row of ``size`` that it is made of, and their weights (sum 1). Where a row shrinks the kernel is as much wider, so that no pixel is passed over."""
    wide = max(size / to, 1.0)
    centre = (np.arange(to) + 0.5) * size / to
    first = np.floor(centre - 2 * wide).astype(np.int64)
    at = first[:, None] + np.arange(int(np.ceil(4 * wide)) + 2)
    weight = np.where((at >= 0) & (at < size), cubic((at + 0.5 - centre[:, None]) / wide), 0.0)
    return np.clip(at, 0, size - 1), weight / weight.cumsum(1)[:, -1:]


#: What is no further from a half is worked out in the order of the definition, as the last bits decide how it is rounded.
NEAR = 1e-6


def resampled(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """An image array at another size, in numbers with a fraction: the sum over its pixels, row by row, each times its row's weight, then its column's. Taken along the rows, then along the columns; that differs in the last bits, so values at a half are summed pixel by pixel."""
    (down, tall), (across, wide) = taps(x.shape[0], height), taps(x.shape[1], width)
    rows = np.einsum("hokc,ok->hoc", x[:, across].astype(np.float64), wide)
    out = np.einsum("okwc,ok->owc", rows[down], tall)
    for i, j, c in np.argwhere(np.abs(out - np.floor(out) - 0.5) < NEAR):
        out[i, j, c] = (x[down[i][:, None], across[j], c] * tall[i][:, None] * wide[j]).cumsum()[-1]
    return out


def resized(rows: DataFrame, height: int, width: int | Column) -> DataFrame:
    """Images at ``height`` and ``width``, by the bicubic kernel, rounded once at the end."""
    wanted = F.lit(width) if isinstance(width, int) else width
    return each_image(rows.withColumn("__width", wanted.cast("int")), lambda x, r: resampled(x, height, r["__width"]), "__width").drop("__width")


def kept_ratio(rows: DataFrame, height: int, most: int) -> DataFrame:
    """Images at ``height`` with their own aspect, ``most`` wide at most."""
    return resized(rows, height, scoring.resized_width(F.col("width"), F.col("height"), height, most))


def model_input(rows: DataFrame, height: int = 32, width: int = 100, keep_ratio: bool = True) -> DataFrame:
    """``rows`` with ``input``: numbers from -1 to 1, channel by channel and row by row, of the image at ``height`` and ``width``; with ``keep_ratio`` a narrower one is filled to the right with its last column. Null images give null."""
    sized = kept_ratio(rows, height, width) if keep_ratio else resized(rows, height, width)

    @F.arrow_udf("array<float>")
    def numbers(h: pa.Array, w: pa.Array, c: pa.Array, data: pa.Array) -> pa.Array:
        out = []
        for a, b, k, d in zip(*(x.to_pylist() for x in (h, w, c, data)), strict=True):
            if d is None:
                out.append(None)
                continue
            x = np.frombuffer(d, np.uint8).reshape(a, b, k)
            x = np.concatenate((x, np.repeat(x[:, -1:], width - b, 1)), 1) if b < width else x
            out.append(((x.transpose(2, 0, 1) / 255.0 - 0.5) / 0.5).astype(np.float32).ravel())
        return pa.array(out, pa.list_(pa.float32()))

    return sized.withColumn("input", numbers(*FIELDS))
