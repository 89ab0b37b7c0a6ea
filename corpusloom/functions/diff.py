"""Line differences: Myers' shortest edit script in linear space, and its rows side by side."""

from __future__ import annotations

from collections.abc import Iterator


def _middle(a: list[int], b: list[int], a0: int, a1: int, b0: int, b1: int, ahead: list[int], back: list[int]) -> tuple[int, int, int, int]:
    """A run of equal lines (x, y to u, v), maybe empty, in the middle of a shortest script of a[a0:a1] and b[b0:b1]."""
    n, m = a1 - a0, b1 - b0
    delta, zero = n - m, m + 1
    odd = delta & 1
    ahead[zero + 1] = 0
    back[zero + 1] = 0
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = ahead[zero + k + 1] if k == -d or (k != d and ahead[zero + k - 1] < ahead[zero + k + 1]) else ahead[zero + k - 1] + 1
            first = x
            while x < n and x - k < m and a[a0 + x] == b[b0 + x - k]:
                x += 1
            ahead[zero + k] = x
            r = delta - k
            if odd and -d < r < d and x + back[zero + r] >= n:
                return a0 + first, b0 + first - k, a0 + x, b0 + x - k
        for k in range(-d + 2 * max(0, d - m), d - 2 * max(0, d - n) + 1, 2):
            x = back[zero + k + 1] if k == -d or (k != d and back[zero + k - 1] < back[zero + k + 1]) else back[zero + k - 1] + 1
            first = x
            while x < n and x - k < m and a[a1 - 1 - x] == b[b1 - 1 - x + k]:
                x += 1
            back[zero + k] = x
            r = delta - k
            if not odd and -d <= r <= d and x + ahead[zero + r] >= n:
                return a1 - x, b1 - x + k, a1 - first, b1 - first + k
    raise AssertionError("no path")


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Ascending (i, j) of a longest common subsequence."""
    in_a, in_b = set(a), set(b)
    # What only one side has is in no common subsequence.
    at_a, at_b = [i for i, x in enumerate(a) if x in in_b], [j for j, x in enumerate(b) if x in in_a]
    a, b = [a[i] for i in at_a], [b[j] for j in at_b]
    ahead, back = [0] * (len(a) + len(b) + 3), [0] * (len(a) + len(b) + 3)
    found: list[tuple[int, int]] = []
    boxes = [(0, len(a), 0, len(b))]
    while boxes:
        a0, a1, b0, b1 = boxes.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 < a1 and b0 < b1:
            x, y, u, v = _middle(a, b, a0, a1, b0, b1, ahead, back)
            found += zip(range(x, u), range(y, v), strict=True)
            boxes += [(a0, x, b0, y), (u, a1, v, b1)]
    return [(at_a[i], at_b[j]) for i, j in sorted(found)]


def lines(text: str | None) -> list[str]:
    """The lines of a text; a line feed at the end opens no line."""
    parts = (text or "").split("\n")
    return parts[:-1] if parts[-1] == "" else parts


def matched(left: list[str], right: list[str]) -> list[tuple[int, int]]:
    numbers: dict[str, int] = {}
    return common([numbers.setdefault(x, len(numbers)) for x in left], [numbers.setdefault(x, len(numbers)) for x in right])


def rows(before: str | None, after: str | None) -> Iterator[tuple[int | None, int | None, str | None, str | None, str]]:
    """(left line number, right one, left line, right line, kind) side by side, numbers from 1.

    Lines removed and added between the same unchanged ones stand beside each other, in their order.  kind: same,
    removed (with or without a line added in its place) or added.
    """
    left, right = lines(before), lines(after)
    i = j = 0
    for x, y in [*matched(left, right), (len(left), len(right))]:
        while i < x or j < y:
            gone, new = i < x, j < y
            yield i + 1 if gone else None, j + 1 if new else None, left[i] if gone else None, right[j] if new else None, "removed" if gone else "added"
            i, j = i + gone, j + new
        if x < len(left):
            yield x + 1, y + 1, left[x], right[y], "same"
            i, j = x + 1, y + 1


def counts(before: str | None, after: str | None) -> tuple[int, int, int]:
    """(added, removed, same) lines, an empty line after the last line feed among them."""
    left, right = (before or "").split("\n"), (after or "").split("\n")
    same = len(matched(left, right))
    return len(right) - same, len(left) - same, same
