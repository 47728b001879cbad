"""Shortest-pack-first packing of a length histogram (worst fit, longest lengths first).

Works on counts only: a pack type is (space left, pieces so far), and n pieces of one length change the
counts of pack types, not single packs. Its cost depends on the number of lengths (at most `capacity`),
not on the number of documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Mapping


def shortest_pack_first(histogram: Mapping[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """Pack types (count, lengths in order of placing) that hold every piece of the histogram once.

    Lengths go longest first, each into the pack with most space left (the shortest pack so far); a new
    pack is opened only if no pack has room.
    """
    spaces: list[int] = []  # distinct spaces left, ascending
    types: dict[int, list[list]] = {}  # space left -> [count, lengths]

    def put(space: int, count: int, lengths: tuple[int, ...]) -> None:
        if space not in types:
            bisect.insort(spaces, space)
            types[space] = []
        for t in types[space]:
            if t[1] == lengths:
                t[0] += count
                return
        types[space].append([count, lengths])

    for length in sorted((x for x, n in histogram.items() if n > 0), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left = histogram[length]
        while left:
            if not spaces or spaces[-1] < length:
                each = capacity // length  # the fewest packs: filled with this length alone
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                left = 0
                continue
            space = spaces[-1]
            kind = types[space][-1]
            take = min(left, kind[0])
            kind[0] -= take
            if not kind[0]:
                types[space].pop()
                if not types[space]:
                    del types[space]
                    spaces.pop()
            put(space - length, take, kind[1] + (length,))
            left -= take
    return [(c, lengths) for space in spaces for c, lengths in types[space]]
