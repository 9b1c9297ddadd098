"""Seeded augmentation: which operations a sample gets, how strong, and their noise follow from (seed, epoch, key) alone, so a draw depends on no partition, order or rerun."""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.pixels import each_image, resampled

#: The argument of an operation at level 10; other levels have their share of it.
FULL = {"GaussianBlur": 4.0, "MotionBlur": 20.0, "GaussianNoise": 25.5, "PoissonNoise": 40.0, "SaltAndPepper": 0.1, "Invert": 0.0, "BorderCrop": 0.0, "RandomResize": 0.0}
LEVELS = 10


def drawn(seed: int, epoch: int, key: Column, what: Column | str) -> Column:
    """A number from 0 up to 1 for a row and a purpose: 52 bits of MD5."""
    what = F.lit(what) if isinstance(what, str) else what
    digest = F.md5(F.concat_ws("-", F.lit(f"{seed}-{epoch}"), key.cast("string"), what))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def schedule(key: Column, epoch: int, seed: int = 0, names: tuple[str, ...] = tuple(FULL), layers: int = 3, magnitude: float = 5.0) -> Column:
    """The operations of a row, in the order of their turn: ``layers`` of ``names`` without repeats, each choice and order as likely as any other, with their argument at ``magnitude``. A null key draws as an empty one."""
    ops = F.array(*(F.struct(F.lit(n).alias("op"), F.lit(FULL.get(n, 0.0) * magnitude / LEVELS).alias("argument")) for n in names))
    turns = F.array_sort(F.transform(ops, lambda o: F.struct(drawn(seed, epoch, key, o["op"]).alias("turn"), o["op"].alias("op"), o["argument"].alias("argument"))))
    return F.transform(F.slice(turns, 1, layers), lambda o: F.struct(o["op"].alias("op"), o["argument"].alias("argument")))


def stream(*of: object) -> np.random.Generator:
    """Random numbers by counter, from a key that holds all that they depend on."""
    return np.random.Generator(np.random.Philox(key=int.from_bytes(blake2b(repr(of).encode(), digest_size=16).digest(), "little")))


def limited(level: float, x: np.ndarray, share: float, least: int = 1, odd: bool = False) -> int:
    """A level as a whole number, at most ``share`` of the image's longer side (at least ``least``); made odd by adding one."""
    out = round(min(level, max(least, share * max(x.shape[:2]))))
    return out | 1 if odd else out


def along(x: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """A centred kernel along one axis; beyond the edge the last pixel stands."""
    reach = len(kernel) // 2
    padded = np.pad(x, [(reach, reach) if i == axis else (0, 0) for i in range(x.ndim)], mode="edge")
    return sum(k * np.take(padded, np.arange(i, i + x.shape[axis]), axis) for i, k in enumerate(kernel))


def gaussian_blur(x: np.ndarray, argument: float, _: np.random.Generator) -> np.ndarray:
    radius = limited(argument, x, 0.02)
    if not radius:
        return x
    at = np.arange(-3 * radius, 3 * radius + 1)
    kernel = np.exp(-(at**2) / (2 * radius**2))
    kernel /= kernel.sum()
    return along(along(x.astype(np.float64), kernel, 1), kernel, 0)


def motion_blur(x: np.ndarray, argument: float, _: np.random.Generator) -> np.ndarray:
    """The mean over a stretch of a row."""
    size = limited(argument, x, 0.08, 3, odd=True)
    return along(x.astype(np.float64), np.full(size, 1 / size), 1)


def gaussian_noise(x: np.ndarray, argument: float, rng: np.random.Generator) -> np.ndarray:
    return x + rng.standard_normal(x.shape) * limited(argument, x, 0.25, odd=True)


def poisson_noise(x: np.ndarray, argument: float, rng: np.random.Generator) -> np.ndarray:
    """Counts of that mean, added or taken off by the toss of a coin."""
    return x + rng.poisson(limited(argument, x, 0.2, odd=True), x.shape) * rng.choice([-1, 1], x.shape)


def salt_and_pepper(x: np.ndarray, argument: float, rng: np.random.Generator) -> np.ndarray:
    """That share of values becomes black or white, half each."""
    chance = rng.random(x.shape)
    return np.where(chance < argument / 2, 0, np.where(chance < argument, 255, x)).astype(np.uint8)


def invert(x: np.ndarray, _: float, __: np.random.Generator) -> np.ndarray:
    return 255 - x


def border_crop(x: np.ndarray, _: float, rng: np.random.Generator) -> np.ndarray:
    """Up to a fortieth goes at the left and the right, up to three fortieths at the top and the bottom; a pixel stays."""
    h, w = x.shape[:2]
    left, top, right, bottom = int(w * rng.uniform(0, 0.025)), int(h * rng.uniform(0, 0.075)), int(w * rng.uniform(0.975, 1)), int(h * rng.uniform(0.925, 1))
    return x[top : max(bottom, top + 1), left : max(right, left + 1)]


def random_resize(x: np.ndarray, _: float, rng: np.random.Generator) -> np.ndarray:
    """Each side between half and one and a half of its own, then both down to a first to a fourth; a pixel stays."""
    sides = [int(rng.integers(math.floor(0.5 * n), math.floor(1.5 * n), endpoint=True)) for n in x.shape[:2]]
    by = int(rng.integers(1, 4, endpoint=True))
    return resampled(x, *(max(1, n // by) for n in sides))


OPERATIONS = {"GaussianBlur": gaussian_blur, "MotionBlur": motion_blur, "GaussianNoise": gaussian_noise, "PoissonNoise": poisson_noise, "SaltAndPepper": salt_and_pepper, "Invert": invert, "BorderCrop": border_crop, "RandomResize": random_resize}


def augmented(rows: DataFrame, key: str, epoch: int, seed: int = 0, names: tuple[str, ...] = tuple(FULL), layers: int = 3, magnitude: float = 5.0) -> DataFrame:
    """Images (see ``sources.pixels``) after the operations of their ``schedule``, which is the column ``ops``; each has noise of its own. Rows that share a key are changed alike; null images stay null."""
    unknown = set(names) - set(OPERATIONS)
    if unknown:
        raise ValueError(f"no such operation: {', '.join(sorted(unknown))}")

    def change(x: np.ndarray, row: dict) -> np.ndarray:
        for op in row["ops"]:
            x = OPERATIONS[op["op"]](x, op["argument"], stream(seed, epoch, row[key], op["op"]))
            x = x if x.dtype == np.uint8 else np.clip(np.floor(x + 0.5), 0, 255).astype(np.uint8)
        return x

    planned = rows.withColumn("ops", schedule(F.col(key), epoch, seed, names, layers, magnitude))
    return each_image(planned, change, key, "ops")
