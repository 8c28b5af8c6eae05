"""Canonical order of the columns of a symmetric result, from a matrix of pair colours.

Colours are refined until stable; where several columns still look alike, each in turn is told apart
(individualised) and the colours are refined again, down to orders of all columns.  The order with the least
matrix wins.  Orders with equal matrices differ by an automorphism of the matrix; columns that known
automorphisms map to an explored one need not be explored, which leaves few branches even where all columns
are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

Matrix = list[list[int]]
Order = list[int]


def _refined(matrix: Matrix, colors: list[int]) -> list[int]:
    """Stable colours, numbered by value so that they do not depend on the order of columns."""
    n, count = len(matrix), len(set(colors))
    while True:
        seen = [(colors[i], sorted((colors[k], matrix[i][k], matrix[k][i]) for k in range(n))) for i in range(n)]
        # a finer colour keeps the order of the colour that it splits
        ranked = sorted(range(n), key=seen.__getitem__)
        colors, last = [0] * n, -1
        for at, i in enumerate(ranked):
            if at == 0 or seen[i] != seen[ranked[at - 1]]:
                last = at
            colors[i] = last
        if len(set(colors)) == count:
            return colors
        count = len(set(colors))


def _told_apart(colors: list[int], column: int) -> list[int]:
    return [2 * c + (c == colors[column] and i != column) for i, c in enumerate(colors)]


def _alike(colors: list[int]) -> list[int]:
    """Columns of the first colour that several have."""
    for c in sorted(set(colors)):
        same = [i for i, x in enumerate(colors) if x == c]
        if len(same) > 1:
            return same
    return []


def canonical_order(matrix: Matrix) -> tuple[Order, list[Order]]:
    """(order, automorphisms): the canonical order and generators of the orders with the same matrix.

    An automorphism ``a`` gives the order ``[a[j] for j in order]``.
    """

    def laid(colors: list[int]) -> Order:
        return sorted(range(len(colors)), key=colors.__getitem__)

    def face(order: Order) -> tuple:
        return tuple(matrix[i][j] for i in order for j in order)

    def mapping(a: Order, b: Order) -> Order:
        out = [0] * len(a)
        for x, y in zip(a, b):
            out[x] = y
        return out

    def first_leaf(colors: list[int]) -> Order:
        while same := _alike(colors):
            colors = _refined(matrix, _told_apart(colors, same[0]))
        return laid(colors)

    def search(colors: list[int]) -> tuple[tuple, Order, list[Order]]:
        same = _alike(colors)
        if not same:
            order = laid(colors)
            return face(order), order, []
        best, group, explored = None, [], []
        for column in same:
            if explored and column in _orbit(explored, group):
                continue
            explored.append(column)
            below = _refined(matrix, _told_apart(colors, column))
            if best is not None:
                quick = first_leaf(below)
                if face(quick) == best[0]:
                    group.append(mapping(best[1], quick))
                    continue
            found = search(below)
            group += found[2]
            if best is None or found[0] < best[0]:
                best = found
            elif found[0] == best[0]:
                group.append(mapping(best[1], found[1]))
        return best[0], best[1], group

    _, order, group = search(_refined(matrix, [0] * len(matrix)))
    return order, group


def _orbit(start: list[int], group: list[Order]) -> set[int]:
    seen, todo = set(start), list(start)
    while todo:
        at = todo.pop()
        for a in group:
            if a[at] not in seen:
                seen.add(a[at])
                todo.append(a[at])
    return seen


def every_order(order: Order, group: list[Order]) -> Iterator[Order]:
    """All orders with the canonical matrix: the group's closure, applied to ``order``."""
    seen, todo = {tuple(order)}, [tuple(order)]
    while todo:
        at = todo.pop()
        yield list(at)
        for a in group:
            new = tuple(a[j] for j in at)
            if new not in seen:
                seen.add(new)
                todo.append(new)
