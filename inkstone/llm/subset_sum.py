"""Bounded subset sums with a bitset: bit s of an integer says that some choice adds up to s."""

from __future__ import annotations

from collections.abc import Iterable


def closest_fill(items: Iterable[tuple[int, int]], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` from ``(length, count)`` items, and how many of each length make it.

    Counts are split into powers of two, so an item costs log(count) shifts. Stops as soon as the capacity is met exactly; the choice is found by walking the kept bitsets back.
    """
    reach, mask, steps = 1, (1 << (capacity + 1)) - 1, []
    full = 1 << capacity
    for length, count in items:
        count = min(count, capacity // length) if length > 0 else 0
        part = 1
        while count > 0 and not reach & full:
            take = min(part, count)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & mask
            count -= take
            part *= 2
        if reach & full:
            break
    left = best = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> left & 1:
            chosen[length] = chosen.get(length, 0) + take
            left -= length * take
    return best, chosen
