"""Two Bloom filters of fixed size over 64-bit hashes: seen once or more, and seen twice or more.

They are built in segments, each merged in one task that streams positions; the caller broadcasts what it asks, at most ``MOST_BITS`` whatever the input. A full filter only lets more rows through: what passes is always confirmed exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEGMENT_BITS = 1 << 18
MOST_BITS = 1 << 30


def bits_for(items: int, each: int = 24) -> int:
    """A power of two with ``each`` bits an item, from 2**20 up to 2**30 (128 MB) however many items there are."""
    return max(1 << 20, min(MOST_BITS, 1 << (max(1, items * each) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int, probes: int) -> np.ndarray:
    """One row of bit positions for each probe."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    low = np.uint64(bits - 1)
    return np.stack([(hashes + np.uint64(i) * step * np.uint64(0x9E3779B97F4A7C15)) & low for i in range(probes)])


def contains(filter_: np.ndarray, hashes: np.ndarray, probes: int) -> np.ndarray:
    """Which hashes may be in a filter (bytes with the lowest bit first)."""
    found = np.ones(len(hashes), bool)
    for at in positions(hashes, len(filter_) * 8, probes):
        found &= (filter_[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return found


def blobs(hashes: np.ndarray, bits: int, probes: int) -> pa.RecordBatch:
    """Rows (segment, positions in it as packed unsigned 32-bit numbers) for ``build``."""
    at = np.sort(positions(hashes, bits, probes).ravel())
    segment = (at // np.uint64(SEGMENT_BITS)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(segment)) + 1
    parts = np.split((at % np.uint64(SEGMENT_BITS)).astype(np.uint32), cuts)
    names = segment[np.concatenate(([0], cuts))] if len(at) else segment
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([p.tobytes() for p in parts] if len(at) else [], pa.binary())], ["segment", "at"])


def gathered(hashes: Iterator[np.ndarray], bits: int, probes: int, at_once: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """``blobs`` of a task's hashes, at least ``at_once`` together, so that rows do not multiply with small batches."""
    wait, n = [], 0
    for h in hashes:
        wait.append(h)
        n += len(h)
        if n >= at_once:
            yield blobs(np.concatenate(wait), bits, probes)
            wait, n = [], 0
    if n:
        yield blobs(np.concatenate(wait), bits, probes)


BLOBS = "segment int, at binary"


def build(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The filters (once, twice) of rows made by ``blobs``. A row counts as seen twice only if it was in the first filter before."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows come sorted by segment: one segment's counters are held at a time.
        counts, current = np.zeros(SEGMENT_BITS, np.uint8), None

        def out() -> pa.RecordBatch:
            kept = [[current], [np.packbits(counts >= 1, bitorder="little").tobytes()], [np.packbits(counts >= 2, bitorder="little").tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(kept[0], pa.int32()), pa.array(kept[1], pa.binary()), pa.array(kept[2], pa.binary())], ["segment", "once", "twice"])

        for batch in batches:
            for segment, at in zip(batch["segment"].to_pylist(), batch["at"].to_pylist(), strict=True):
                if segment != current:
                    if current is not None:
                        yield out()
                    counts[:], current = 0, segment
                found, n = np.unique(np.frombuffer(at, np.uint32), return_counts=True)
                counts[found] = np.minimum(2, counts[found] + np.minimum(n, 2))
        if current is not None:
            yield out()

    merged = rows.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, once binary, twice binary")
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    width = SEGMENT_BITS // 8
    for segment, a, b in merged.toLocalIterator():
        once[segment * width : (segment + 1) * width] = np.frombuffer(a, np.uint8)
        twice[segment * width : (segment + 1) * width] = np.frombuffer(b, np.uint8)
    return once, twice
