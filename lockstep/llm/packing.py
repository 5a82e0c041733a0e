"""Bin packing of a multiset of lengths: Martello-Toth dominance reduction, then best fit decreasing.

Works on counts of lengths, so its cost depends on the capacity and not on the number of documents. A pattern is a multiset of lengths that fills one bin, used a number of times.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

Pattern = tuple[tuple[int, int], ...]


def _pattern(lengths: list[int]) -> Pattern:
    return tuple((x, lengths.count(x)) for x in sorted(set(lengths), reverse=True))


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Bins that some optimal packing has, and the counts that are left.

    Taking the longest item j, a set F with j dominates all other sets with j if each of those can be swapped against F without
    using more bins (Martello and Toth):
    no other item fits beside j: F = {j};
    j and some item fill the bin: F = {j, that item};
    no two other items fit beside j: F = {j, the longest item that fits}.
    Items for which no rule holds stay; each fixed bin shrinks the instance, so rules are tried again for the rest.
    """
    left = {n: c for n, c in counts.items() if c}
    sizes = sorted(left)
    fixed: list[tuple[Pattern, int]] = []

    def take(pattern: list[int], times: int) -> None:
        fixed.append((_pattern(pattern), times))
        for n in pattern:
            left[n] -= times
            if not left[n]:
                del left[n]
                sizes.pop(bisect_left(sizes, n))

    def others(j: int) -> list[int]:
        """The two shortest items beside one of length j."""
        return [n for n in sizes[:3] for _ in range(min(2, left[n] - (n == j)))][:2]

    shrunk = True
    while shrunk:
        shrunk, i = False, len(sizes) - 1
        while i >= 0:
            j = sizes[i]
            room, least = capacity - j, others(j)
            times = lambda k: left[j] // 2 if k == j else min(left[j], left[k])  # noqa: E731, B023
            if not least or least[0] > room:
                take([j], left[j])
            elif room in left and (room != j or left[j] > 1):
                take([j, room], times(room))
            elif len(least) < 2 or sum(least) > room:
                k = sizes[bisect_right(sizes, room) - 1]
                if k == j and left[j] == 1:
                    k = sizes[i - 1]
                take([j, k], times(k))
            else:
                i -= 1
                continue
            shrunk = True
            i = min(bisect_right(sizes, j) - 1, len(sizes) - 1)
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best fit decreasing: each item into the fullest bin that it fits, a group of equal bins at a time."""
    groups: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(room: int, pattern: list[int], times: int) -> None:
        if times:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((pattern, times))

    for n in sorted(counts, reverse=True):
        todo = counts[n]
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = capacity // n
                put(capacity - each * n, [n] * each, todo // each)
                put(capacity - todo % each * n, [n] * (todo % each), 1 if todo % each else 0)
                break
            room = rooms[at]
            pattern, times = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // n
            full = min(times, todo // each)
            put(room - each * n, pattern + [n] * each, full)
            todo -= full * each
            times -= full
            if times and todo:
                some = min(each, todo)
                put(room - some * n, pattern + [n] * some, 1)
                todo -= some
                times -= 1
            put(room, pattern, times)
    return [(_pattern(p), times) for room in groups for p, times in groups[room]]


def pack(counts: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    if any(not 0 < n <= capacity for n in counts):
        raise ValueError("lengths must lie between 1 and the capacity")
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)
