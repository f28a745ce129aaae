"""Optimal bipartite assignment: most pairs first, then least cost; ties by the smaller row, then the smaller column."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lensfold.operators.components import connected_components
from lensfold.operators.groups import Group, fold_batches, fold_groups, settled

Solver = Callable[[np.ndarray], np.ndarray]


def shortest_paths(cost: np.ndarray) -> np.ndarray:
    """Column of each row in a finite matrix with no more rows than columns, by shortest augmenting paths with potentials."""
    n, m = cost.shape
    u, v, row_of, way = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1), np.zeros(m + 1, int)
    for i in range(n):
        row_of[m], j = i, m
        least, used = np.full(m, np.inf), np.zeros(m + 1, bool)
        while row_of[j] >= 0:
            used[j] = True
            r = row_of[j]
            reduced = cost[r] - u[r] - v[:m]
            free = ~used[:m]
            better = free & (reduced < least)
            least[better], way[:m][better] = reduced[better], j
            k = int(np.where(free, least, np.inf).argmin())
            step = least[k]
            u[row_of[used]] += step
            v[used] -= step
            least[free] -= step
            j = k
        while j != m:
            row_of[j] = row_of[way[j]]
            j = way[j]
    out = np.empty(n, int)
    for j in range(m):
        if row_of[j] >= 0:
            out[row_of[j]] = j
    return out


_SOLVERS: dict[str, Solver] = {"shortest_paths": shortest_paths}
_DEFAULT = ["shortest_paths"]


def register_solver(name: str, solver: Solver) -> None:
    _SOLVERS[name] = solver


def available_solvers() -> list[str]:
    return sorted(_SOLVERS)


@contextmanager
def default_solver(solver: str | Solver) -> Iterator[None]:
    """Use another solver for the time of a ``with`` block. It is given a finite matrix with at least as many columns as rows."""
    if callable(solver):
        _SOLVERS["custom"], name = solver, "custom"
    else:
        name = solver
    _DEFAULT.append(name)
    try:
        yield
    finally:
        _DEFAULT.pop()


def assign(cost: np.ndarray, solver: str | Solver | None = None) -> list[tuple[int, int]]:
    """Pairs (row, column) of a cost matrix in which NaN or infinity forbids a pair.

    Forbidden costs become larger than any sum of allowed ones, so as many allowed pairs as possible are made, and then the
    cheapest. The matrix is not changed.
    """
    cost = np.array(cost, dtype=float, ndmin=2)
    ok = np.isfinite(cost)
    if not ok.any():
        return []
    n, m = cost.shape
    full = np.where(ok, cost, 2 * min(n, m) * (np.abs(cost[ok]).max() + 1) + 1)
    solve = solver if callable(solver) else _SOLVERS[solver or _DEFAULT[-1]]
    turned = n > m
    full = full.T.copy() if turned else full
    columns = full.argmin(axis=1)
    if len(set(columns.tolist())) < len(columns):  # else each row has its cheapest column, and no assignment is cheaper
        columns = solve(full)
    pairs = [(int(c), r) if turned else (r, int(c)) for r, c in enumerate(columns)]
    return sorted(p for p in pairs if ok[p])


def assign_groups(edges: DataFrame, keys: list[str], row: str, column: str, cost: str, maximise: bool = False, solver: str | Solver | None = None) -> DataFrame:
    """``keys, row, column, cost`` of the optimal pairs in each group of ``edges``; a pair without an edge is forbidden.

    One group's matrix is solved in one task: group by what bounds it, such as a frame. ``solver``, or the one in use where this
    is called, is sent to the tasks.
    """
    solver = solver if callable(solver) else _SOLVERS[solver or _DEFAULT[-1]]
    edges = edges.select(*keys, row, column, cost)

    def solve(g: Group, starts: np.ndarray) -> Group | None:
        own = chosen_edges(starts, g[row], g[column], g[cost] * (-1 if maximise else 1), solver)
        return {n: v[own] for n, v in g.items()} if len(own) else None

    return fold_batches(edges, keys, solve, edges.schema)


def places_in_groups(starts: np.ndarray, group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each of the ``ids`` among the distinct ones of its group, and how many of these each group has."""
    order = np.lexsort((ids, group))
    same = (group[order][1:] == group[order][:-1]) & (ids[order][1:] == ids[order][:-1])
    number = np.cumsum(np.append(True, ~same)) - 1
    first = number[starts]
    out = np.empty(len(ids), np.int64)
    out[order] = number - first[group]
    return out, np.diff(np.append(first, number[-1] + 1))


def _optimal(starts: np.ndarray, rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, solve: Solver, absent: float, cells: int = 1 << 21) -> np.ndarray:
    """Places of the edges that the optimal assignment of each group uses.

    Pairs without an edge cost ``absent``; NaN forbids them, as :func:`assign` does. Groups of one shape are one array, in which
    those are settled at once whose rows all have their own cheapest column; the others are given to ``solve``.
    """
    if not len(rows):
        return np.empty(0, int)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    (i, heights), (j, widths) = (places_in_groups(starts, group, x) for x in (rows, columns))
    shapes, of = np.unique(np.stack((heights, widths)), axis=1, return_inverse=True)
    of = of.ravel()
    edges = np.argsort(of[group], kind="stable")
    ends = np.cumsum(np.bincount(of[group], minlength=shapes.shape[1]))
    found = []
    for k, (n, m) in enumerate(shapes.T.tolist()):
        all_edges = edges[ends[k - 1] if k else 0 : ends[k]]
        slots = np.cumsum(np.append(True, group[all_edges][1:] != group[all_edges][:-1])) - 1
        most = max(1, cells // (n * m))
        for at in range(0, slots[-1] + 1, most):
            lo, hi = np.searchsorted(slots, (at, at + most))
            own, slot = all_edges[lo:hi], slots[lo:hi] - at
            full, place = np.full((slot[-1] + 1, n, m), absent), np.zeros((slot[-1] + 1, n, m), int)
            full[slot, i[own], j[own]], place[slot, i[own], j[own]] = cost[own], own
            ok = np.isfinite(full)
            if not ok.all():
                top = np.where(ok, np.abs(full), 0.0).max((1, 2))
                full = np.where(ok, full, (2 * min(n, m) * (top + 1) + 1)[:, None, None])
            if n > m:
                full, place, ok = (x.transpose(0, 2, 1) for x in (full, place, ok))
            best = full.argmin(2)
            taken = np.sort(best, axis=1)
            for b in np.flatnonzero((taken[:, 1:] == taken[:, :-1]).any(1) & ok.any((1, 2))):
                best[b] = solve(full[b].copy())
            used = np.arange(len(best))[:, None], np.arange(best.shape[1])[None, :], best
            found.append(place[used][ok[used] & ((full[used] < 0) | np.isnan(absent))])
    return np.sort(np.concatenate(found))


def chosen_edges(starts: np.ndarray, rows: np.ndarray, columns: np.ndarray, cost: np.ndarray, solver: str | Solver | None = None) -> np.ndarray:
    """Places of the edges (row, column, cost) that the optimal assignments use; groups of edges begin at ``starts``."""
    return _optimal(starts, rows, columns, cost, solver if callable(solver) else _SOLVERS[solver or _DEFAULT[-1]], np.nan)


def best_edges(starts: np.ndarray, rows: np.ndarray, columns: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Places of the edges (row, column, score) of the matchings with the greatest total; absent pairs and pairs of 0 add nothing and are left out.

    Groups of edges begin at ``starts``.
    """
    return _optimal(starts, rows, columns, -score, _SOLVERS[_DEFAULT[-1]], 0.0)


def heaviest_matching(rows: np.ndarray, columns: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Places of the edges (row, column, weight > 0) of the matching with the greatest total weight, in memory for the edges only.

    Shortest augmenting paths over adjacency lists. Prices of rows and columns cover every edge's weight; a path from a new
    row ends at a free column or at a row that is cheapest left alone. Whole weights give an exact optimum.
    """
    r, i = np.unique(rows, return_inverse=True)
    c, j = np.unique(columns, return_inverse=True)
    order = np.lexsort((j, i))
    start = np.searchsorted(i[order], np.arange(len(r) + 1)).tolist()
    source, head, weight = i[order].tolist(), j[order].tolist(), weights[order].tolist()
    row_price = [max(weight[a:b]) for a, b in zip(start[:-1], start[1:], strict=True)]
    price, edge_of, row_of = [0] * len(c), [-1] * len(r), [-1] * len(c)
    for s in range(len(r)):
        seen, came, done, heap = {s: 0}, {}, {}, []
        best, alone, column, at, way = row_price[s], s, -1, s, 0  # the path may end at ``column``, or leave the row ``alone``
        while True:
            for e in range(start[at], start[at + 1]):
                k = head[e]
                far = way + row_price[at] + price[k] - weight[e]
                if far < best and k not in done and (k not in came or far < came[k][0]):
                    came[k] = far, e
                    if row_of[k] < 0:
                        best, column = far, k
                    else:
                        heappush(heap, (far, k))
            while heap and heap[0][1] in done:
                heappop(heap)
            if not heap or heap[0][0] >= best:
                break
            way, k = heappop(heap)
            done[k], at = way, row_of[k]
            seen[at] = way
            if way + row_price[at] < best:
                best, alone, column = way + row_price[at], at, -1
        for x, far in seen.items():
            row_price[x] -= max(0, best - far)
        for k, far in done.items():
            price[k] += max(0, best - far)
        if column < 0 and alone != s:
            column, edge_of[alone] = head[edge_of[alone]], -1
        while column >= 0:
            e = came[column][1]
            x = source[e]
            row_of[column], before, edge_of[x] = x, edge_of[x], e
            column = head[before] if x != s else -1
    return np.sort(order[[e for e in edge_of if e >= 0]])


def heaviest_pairs(edges: DataFrame, keys: list[str], row: str, column: str, weight: str, whole: int = 200_000) -> DataFrame:
    """``keys, row, column, weight``: in each group of ``edges`` the pairs of the matching with the greatest total weight.

    Rows and columns are bigints, one edge a pair; edges with nulls or without positive weight are left out. A group of more
    than ``whole`` edges is first split into its connected parts, which are dealt over all tasks; smaller groups and parts
    are solved each in one task, in memory for their edges.
    """
    edges = edges.select(*keys, row, column, weight).filter(f"{weight} > 0").dropna()

    def solve(g: Group) -> Group | None:
        chosen = heaviest_matching(g[row], g[column], g[weight])
        return {n: g[n][chosen] for n in (*keys, row, column, weight)} if len(chosen) else None

    large = settled(edges.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > whole).drop("_n"))
    if large.isEmpty():
        return fold_groups(edges, keys, solve, edges.schema)
    node = lambda c, side: F.struct(F.lit(side).alias("side"), F.col(c).cast("long").alias("id"))
    nodes = edges.join(large, keys, "left_semi").select(*keys, node(row, 0).alias("u"), node(column, 1).alias("v"))
    parts = connected_components(nodes, tuple(keys)).filter("node.side = 0")
    parts = parts.select(*keys, F.col("node.id").alias(row), F.col("component.id").alias("_part"))
    split = edges.join(parts, [*keys, row], "left").fillna({"_part": 0})  # smaller groups stay whole
    return fold_groups(split, [*keys, "_part"], solve, edges.schema)
