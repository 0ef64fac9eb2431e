"""Forest of random-projection trees over vectors.

The hyperplanes are fitted on a bounded sample and broadcast (size bound below); every row is routed. A row's leaves are
taken through one priority queue shared by all trees, best first over their nodes: a node's priority is the largest
distance by which the path to it crosses a hyperplane to the wrong side, so the row's own leaf of each tree comes first
and leaves behind near planes follow. One shuffle brings rows and their searches together by leaf; inside a leaf all
candidates are reranked by exact cosines. Exact copies of a vector are collapsed before, so a leaf can't be flooded by one
vector. Planes part groups that outgrow a leaf; where a least cosine is asked, ``Cells`` keep such groups whole and ``Grids``
take the place of the trees for other rows.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.plans.scratch import Scratch, broadcast_if

#: Rows on which the hyperplanes are fitted, at most.
SAMPLE_ROWS = 32_768
#: Fewest sample rows in a leaf: a forest has at most TREES * SAMPLE_ROWS / MIN_SAMPLE_LEAF planes (3 MB at 96 components).
MIN_SAMPLE_LEAF = 16
#: Most bytes of a forest whose leaves are split further by trees of their own; beyond it (1.2 billion rows at leaves of
#: 8192 rows and five trees) leaves grow with the data again.
FOREST_BYTES = 256 << 20
#: Rows that a leaf should hold. A leaf that holds more than twice as many all the same is split inside its own task.
LEAF_ROWS = 4096
TREES = 4
#: Fewest sample rows of a dense group that has a cell of its own; so there are at most SAMPLE_ROWS / CELL_SAMPLE cells.
CELL_SAMPLE = 8
#: Least cosine asked for which cells are looked for: below it a cell would reach over unrelated rows.
CELL_COS = 0.5
#: Widest angle between a cell's center and its core rows.
CELL_WIDE = 0.5
#: Rows of a cell that one block may hold; any two blocks of a cell meet in one task.
BLOCK_ROWS = 65_536
#: Cosines that a task holds at once.
AT_ONCE = 1 << 22
#: Cosines in single precision that are closer than this may be equal in millionths.
TIED = 5e-6
#: Leaves of grids that share a task, at most. A row is sent to a task once, whichever of its leaves it goes to; a task then holds
#: about 24 times as many rows as a leaf (README).
TOGETHER = 8
#: Tables up to so many rows may be broadcast; larger ones are shuffled.
SMALL = 100_000


@dataclass
class Tree:
    normals: np.ndarray  # planes x d
    offsets: np.ndarray
    below: np.ndarray  # child of each plane: another plane, or -1 - leaf
    above: np.ndarray
    leaves: int


def fit_tree(x: np.ndarray, leaf: int, seed: int, tries: int = 8) -> Tree:
    """Splits by planes between two random rows where both sides fill whole leaves evenly. Of ``tries`` planes the one with the fewest rows close
    to it is kept, so that neighbours are seldom parted."""
    rng = np.random.default_rng(seed)
    normals, offsets, below, above = [], [], [], []
    leaves = 0
    todo: list[tuple[np.ndarray, int, bool]] = [(np.arange(len(x)), -1, False)]
    while todo:
        rows, parent, is_above = todo.pop()
        best = None
        if len(rows) > leaf:
            parts = -(-len(rows) // leaf)
            for _ in range(tries):
                a, b = x[rng.choice(rows, 2, replace=False)]
                w = a - b
                norm = np.linalg.norm(w)
                if norm < 1e-6:
                    continue
                w = w / norm
                m = x[rows] @ w
                cut = np.quantile(m, parts // 2 / parts)
                if (np.abs(m - cut) < TIED).sum() > 8 + len(rows) // 100:  # scaled copies: rounding must not part them
                    cut = cut - 2 * TIED if (m < cut - 2 * TIED).any() else cut + 2 * TIED
                low = m < cut
                if not 0 < low.sum() < len(rows):
                    continue
                near = float((np.abs(m - cut) < 0.05).mean())
                if best is None or near < best[0]:
                    best = (near, w, cut, low)
        if best is None:
            me, leaves = -1 - leaves, leaves + 1
        else:
            _, w, cut, low = best
            me = len(offsets)
            normals.append(w)
            offsets.append(cut)
            below.append(0)
            above.append(0)
            todo += [(rows[low], me, False), (rows[~low], me, True)]
        if parent >= 0:
            (above if is_above else below)[parent] = me
    d = x.shape[1]
    return Tree(np.array(normals, np.float32).reshape(-1, d), np.array(offsets, np.float32), np.array(below, int), np.array(above, int), leaves)


class Forest:
    """The trees in one set of arrays: planes and leaves are numbered through all trees."""

    def __init__(self, trees: list[Tree]):
        self.trees = trees
        self.first = np.cumsum([0] + [t.leaves for t in trees])
        planes = np.cumsum([0] + [len(t.offsets) for t in trees])
        self.roots = np.array([p if len(t.offsets) else -1 - f for t, p, f in zip(trees, planes, self.first)], np.int32)
        self.normals = np.concatenate([t.normals for t in trees])
        self.offsets = np.concatenate([t.offsets for t in trees])
        shift = lambda child, p, f: np.where(child < 0, child - f, child + p)
        self.below, self.above = (
            np.concatenate([shift(side(t), p, f) for t, p, f in zip(trees, planes, self.first)]).astype(np.int32)
            for side in (lambda t: t.below, lambda t: t.above))

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Rows x probes: the leaves of each row in the order of one priority queue over the nodes of all trees, -1 where
        there are fewer. The queue starts with the roots. The node of least cost is popped and followed down to a leaf on
        the row's side of each plane; the other sides are pushed at the largest distance by which their path crosses a
        plane to the wrong side. Nodes that are never popped are never looked at. Rows take their steps together: a column
        of ``cost`` and ``node`` is a place in every row's queue. As roots cost nothing, a row's own leaf of every tree
        comes first, in the order of the trees."""
        n, trees = len(x), len(self.roots)
        out = np.full((n, probes), -1, np.int64)
        cost = np.full((n, trees + 16), np.inf, np.float32)
        node = np.zeros(cost.shape, np.int32)
        cost[:, :trees], node[:, :trees] = 0, self.roots
        fill, every = np.full(n, trees), np.arange(n)
        for p in range(probes):
            place = cost[:, : fill.max(initial=trees)].argmin(1)
            paid, at = cost[every, place], node[every, place]
            cost[every, place] = np.inf
            rows = np.flatnonzero(np.isfinite(paid))
            paid, at = paid[rows], at[rows]
            while len(rows):
                inner = at >= 0
                out[rows[~inner], p] = -1 - at[~inner]
                rows, paid, at = rows[inner], paid[inner], at[inner]
                if not len(rows):
                    break
                side = np.einsum("ij,ij->i", x[rows], self.normals[at]) - self.offsets[at]
                low, to = side < 0, fill[rows]
                if to.max() >= cost.shape[1]:
                    cost = np.concatenate([cost, np.full((n, 32), np.inf, np.float32)], 1)
                    node = np.concatenate([node, np.zeros((n, 32), np.int32)], 1)
                cost[rows, to] = np.maximum(paid, np.abs(side))
                node[rows, to] = np.where(low, self.above[at], self.below[at])
                fill[rows] += 1
                at = np.where(low, self.below[at], self.above[at])
        return out


def fit_forest(x: np.ndarray, rows: int, *, trees: int = TREES, leaf_rows: int = LEAF_ROWS, seed: int = 7) -> Forest:
    """``x``: unit rows of the sample; ``rows``: how many rows will be indexed."""
    leaf = max(MIN_SAMPLE_LEAF, int(leaf_rows * len(x) / max(rows, 1)))
    if rows <= leaf_rows:
        leaf = max(len(x), 1)
    return Forest([fit_tree(x, leaf, seed + t) for t in range(trees)])


class Grids:
    """Leaves around centers that are rows of the sample, several grids of them; used like a ``Forest``. Close rows stay
    together far more often than below ten planes, so fewer copies of a row reach its neighbours, in large tables above all.
    Leaves that the same rows go to share a ``task``, each with its ``place`` there."""

    def __init__(self, x: np.ndarray, rows: int, grids: int, leaf_rows: int, seed: int = 7, probes: int = 8):
        n = 1 if rows <= leaf_rows else min(len(x), -(-rows // leaf_rows))
        pick = [np.random.default_rng(seed + g).choice(len(x), n, replace=False) if n > 1 else [] for g in range(grids)]
        self.centers = np.array([x[p] if n > 1 else np.zeros((1, x.shape[1])) for p in pick], np.float32)
        self.roots = np.zeros(grids)
        self.first = np.arange(grids + 1) * max(n, 1)
        self.task, self.place = share(self.search(x, probes), self.first[-1])

    def search(self, x: np.ndarray, probes: int) -> np.ndarray:
        """Rows x probes: first a row's own leaf of every grid (its nearest center), then the leaves of all grids in one
        order, by how much less their center's cosine is than the own leaf's; -1 where there are fewer."""
        grids, n = self.centers.shape[:2]
        most = min(probes, grids * n)
        out = np.full((len(x), probes), -1, np.int64)
        step = max(1, min(4096, AT_ONCE // (grids * n)))
        for at in range(0, len(x), step):
            cos = np.stack([x[at : at + step] @ c.T for c in self.centers], 1)
            less = cos.max(2, keepdims=True) - cos
            np.put_along_axis(less, cos.argmax(2)[:, :, None], -1 + np.arange(grids, dtype=np.float32)[:, None] / grids, 2)
            less = less.reshape(len(less), -1)
            near = np.argpartition(less, most - 1, axis=1)[:, :most] if most < less.shape[1] else np.tile(np.arange(most), (len(less), 1))
            order = np.argsort(np.take_along_axis(less, near, 1), axis=1, kind="stable")
            out[at : at + step, :most] = np.take_along_axis(near, order, 1)
        return out


def share(leaves: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Task and place in it of each of ``count`` leaves, of which the sample's rows go to ``leaves`` (-1: none). A task starts with
    the leaf that most rows go to and takes the one that shares most rows with its leaves, until it has TOGETHER or as many rows
    as so many leaves have on average; a leaf that has more is alone."""
    a, b = leaves[:, :, None], leaves[:, None, :]
    pairs, rows = np.unique((a * count + b)[(a != b) & (a >= 0) & (b >= 0)], return_counts=True)
    first, other = np.searchsorted(pairs, np.arange(count + 1) * count), pairs % count
    task, place = np.zeros(count, np.int64), np.zeros(count, np.int64)
    free, held = np.ones(count, bool), np.bincount(leaves[leaves >= 0], minlength=count)
    at, size, load, common = -1, TOGETHER, 0, held
    for _ in range(count):
        fits = free & (held + load <= TOGETHER * held.mean())
        if size == TOGETHER or not fits.any():
            at, size, load, common, fits = at + 1, 0, 0, held.copy(), free
        leaf = int(np.where(fits, common, -1).argmax())
        if not size:
            common[:] = 0
        free[leaf], task[leaf], place[leaf], size, load = False, at, size, size + 1, load + held[leaf]
        common[other[first[leaf] : first[leaf + 1]]] += rows[first[leaf] : first[leaf + 1]]
    return task, place


class Cells:
    """Dense groups that are compared whole, at any size. A cell has a center, core rows (at most an angle b from it) and
    all rows at most b + acos(least cosine asked) from it. By the triangle inequality every row that reaches this cosine with
    a core row is in its cell: core rows need no other leaf, and none of their pairs is missed. Rows of a cell that are core
    in none are searched in their cells and in the grids. A cell has ``blocks``, by hash of the id; a task holds two of them."""

    def __init__(self, centers: np.ndarray, wide: np.ndarray, blocks: np.ndarray, min_cos: float):
        self.centers, self.blocks = centers.astype(np.float32), blocks.astype(np.int64)
        self.core = np.cos(wide).astype(np.float32)
        self.edge = (np.cos(np.minimum(wide + np.arccos(min_cos), np.pi)) - 1e-4).astype(np.float32)
        self.first = np.cumsum(np.r_[0, self.blocks * (self.blocks + 1) // 2])

    def is_core(self, u: np.ndarray) -> np.ndarray:
        return np.concatenate([(u[i : i + 4096] @ self.centers.T >= self.core).any(1) for i in range(0, len(u), 4096)] or [np.zeros(0, bool)])

    def place(self, u: np.ndarray, ids: np.ndarray, role: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which rows are core, and row, task and role of all that are in cells; role 4 marks a task's second block. Rows
        that are core elsewhere aren't searched for again where they are no core."""
        c = u @ self.centers.T
        own = c >= self.core
        core = own.any(1)
        i, j = np.nonzero(c >= self.edge)
        roles = np.where(core[i] & ~own[i, j], role & 1, role)
        i, j, roles = i[roles > 0], j[roles > 0], roles[roles > 0]
        n = self.blocks[j]
        block = ((ids[i].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % n
        got = [], [], []
        for other in range(n.max(initial=0)):
            at = np.flatnonzero(n > other)
            low, high = np.minimum(block[at], other), np.maximum(block[at], other)
            got[0].append(i[at])
            got[1].append(self.first[j[at]] + low * n[at] - low * (low - 1) // 2 + high - low)
            got[2].append(roles[at] + 4 * (block[at] > other))
        return core, *(np.concatenate(g) if g else np.zeros(0, np.int64) for g in got)


def fit_cells(x: np.ndarray, rows: int, min_cos: float) -> Cells | None:
    """``x``: unit rows of the sample; ``rows``: how many rows there are. Each row that no cell has as core yet leads those
    near it; they have a cell if most rows that it must hold are core."""
    if min_cos < CELL_COS:
        return None
    free, reach = np.ones(len(x), bool), np.arccos(min(min_cos, 1.0))
    centers, wide, blocks = [], [], []
    while free.any():
        at = np.flatnonzero(free)
        leads = at[:256]
        s = x[leads] @ x[at].T
        for lead, cos in zip(leads, s):
            if not free[lead]:
                continue
            free[lead] = False
            near = at[cos >= min_cos]
            if len(near) < CELL_SAMPLE or free[near].sum() + 1 < CELL_SAMPLE:
                continue
            center = unit(x[near].mean(0, keepdims=True))[0]
            angle = np.arccos(np.clip(x @ center, -1, 1))
            n = len(near)  # the center is nearer to the rows that it is the mean of than to others
            b = min(CELL_WIDE, float(np.quantile(angle[near], 0.98)) * ((n + 1) / (n - 1)) ** 0.5 + 0.04)
            core, inside = angle <= b, int((angle <= b + reach).sum())
            if core.sum() < CELL_SAMPLE or inside > 2 * core.sum():
                continue
            free &= ~core
            centers.append(center)
            wide.append(b)
            blocks.append(max(1, -(-inside * rows // (len(x) * BLOCK_ROWS))))
    return Cells(np.array(centers), np.array(wide), np.array(blocks), min_cos) if centers else None


def graft(tree: Tree, subtrees: dict[int, Tree]) -> Tree:
    """``tree`` with some leaves replaced by trees of their own; leaves are numbered anew."""
    normals, offsets = [tree.normals], [tree.offsets]
    below, above, planes, leaves, to = [], [], len(tree.offsets), 0, {}
    for old in range(tree.leaves):
        t = subtrees.get(old)
        if t is None or not len(t.offsets):
            to[old], leaves = -1 - leaves, leaves + 1
            continue
        to[old] = planes
        normals.append(t.normals)
        offsets.append(t.offsets)
        for side, children in ((below, t.below), (above, t.above)):
            side.append(np.where(children < 0, children - leaves, children + planes))
        planes, leaves = planes + len(t.offsets), leaves + t.leaves
    first = [np.array([to[-1 - c] if c < 0 else c for c in side], int) for side in (tree.below, tree.above)]
    return Tree(np.concatenate(normals), np.concatenate(offsets), np.concatenate([first[0], *below]), np.concatenate([first[1], *above]), leaves)


def unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    return (x / np.where(n > 0, n, 1)).astype(np.float32)


def matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows x ``dim``: floats from arrays or bytes, 8-bit codes from bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        if not len(column):
            return np.zeros((0, dim), np.float32)
        offsets = np.frombuffer(column.buffers()[1], np.int32 if pa.types.is_binary(column.type) else np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return raw.view(np.float32 if len(raw) == 4 * dim * len(column) else np.int8).reshape(len(column), dim)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(len(column), dim)


def packed(x: np.ndarray) -> pa.Array:
    """Rows as bytes."""
    x = np.ascontiguousarray(x)
    offsets = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(x)])


def usable(df: DataFrame, id: str, vector: str, dim: int) -> DataFrame:
    """``id, vector`` of rows with an id and a finite vector of ``dim`` components that is not zero."""
    return df.select(df[id].cast("long").alias("id"), df[vector].cast("array<float>").alias("vector")).where(F.col("id").isNotNull() & is_usable(F.col("vector"), dim))


def is_usable(v: Column, dim: int) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return (F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)


def fingerprint() -> list:
    """128 bits of a vector's components."""
    return [F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(91), F.col("vector")).alias("h2")]


def collapse(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, int]:
    """Of ``usable`` rows: one representative (smallest id) of each set of exact copies; ``id, rep`` of all copies that
    aren't representatives, and their number. Only hashes are shuffled; a set of copies is combined before the shuffle.
    Rows that repeat an id with the same vector count once; with another vector, the one of the smaller hash stays."""
    prints = rows.select("id", *fingerprint())
    one_id = prints.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("h1", "h2")).alias("h"))
    one_id = scratch.table(one_id.select("id", "n", "h.h1", "h.h2"), "prints")
    if one_id.where("n > 1").limit(1).count():
        keep = F.min_by(F.col("vector"), F.struct(*fingerprint()))
        rows = scratch.table(rows.groupBy("id").agg(keep.alias("vector")), "one-row-an-id")
    shared = one_id.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).where("n > 1")
    shared = scratch.table(shared.select("h1", "h2", "rep"), "shared")
    sets = shared.count()
    copies = one_id.select("id", "h1", "h2").join(broadcast_if(shared, sets, SMALL), ["h1", "h2"]).where("id != rep").select("id", "rep")
    copies = scratch.table(copies, "copies")
    n = copies.count()
    reps = rows.join(broadcast_if(copies.select("id"), n, SMALL), "id", "left_anti") if n else rows
    scratch.drop(one_id)
    return reps, copies, n


def sample(rows: DataFrame, count: int, most: int = SAMPLE_ROWS) -> tuple[np.ndarray, int]:
    """About ``most`` rows chosen by hash of their id: the same ones each run."""
    spread = max(1, count // most)
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(spread)) == 0).orderBy(F.xxhash64("id"), "id").limit(most)
    got = picked.select("vector").toArrow()
    return got.column(0), count


def sampled(rows: DataFrame, count: int, dim: int, most: int = SAMPLE_ROWS) -> np.ndarray:
    """The sample as unit rows."""
    column, _ = sample(rows, count, most)
    return unit(matrix(column, dim)) if len(column) else np.zeros((0, dim), np.float32)


def grids(x: np.ndarray, count: int, *, trees: int = TREES, leaf_rows: int = LEAF_ROWS, probes: int = 8, cells: Cells | None = None) -> Grids:
    """Grids for ``count`` rows of which ``x`` is the sample, or for those that aren't core in ``cells``; ``probes`` leaves are searched."""
    if cells is not None:
        rest = ~cells.is_core(x)
        x, count = x[rest], round(count * rest.mean())
    return Grids(x, count, trees, leaf_rows, probes=probes)


def learn(
    rows: DataFrame, count: int, dim: int, *, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS,
    x: np.ndarray | None = None,
) -> Forest:
    """A forest for ``rows`` (id, vector); ``x`` is their sample if there is one. Where the sample is too small for leaves of ``leaf_rows``, the leaves' own
    subtrees are fitted in parallel, on every (leaf_rows / MIN_SAMPLE_LEAF)-th row, before any row is brought to its leaf."""
    if x is None:
        x = sampled(rows, count, dim, sample_rows)
    forest = fit_forest(x, count, trees=trees, leaf_rows=leaf_rows)
    wanted = max(leaf_rows, count * trees * 4 * (dim + 4) // FOREST_BYTES)  # rows a leaf that the forest's size allows
    if count * MIN_SAMPLE_LEAF <= 2 * wanted * max(len(x), 1):
        return forest
    spread = max(1, wanted // MIN_SAMPLE_LEAF)
    some = rows.where(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(spread)) == 0)

    def fit(table: pa.Table) -> pa.Table:
        leaf = table.column("leaf")[0].as_py()
        tree = fit_tree(unit(matrix(table.column("vector"), dim)), max(1, wanted // spread), leaf)
        return pa.table({"leaf": pa.array([leaf], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    fitted = route(some, forest, dim, member=True, query=False, probes=0, coarse=False).groupBy("leaf").applyInArrow(fit, "leaf int, tree binary")
    deep = {r["leaf"]: pickle.loads(r["tree"]) for r in fitted.collect()}  # FOREST_BYTES at most
    return Forest([graft(t, {x - f: deep[x] for x in range(f, f + t.leaves) if x in deep}) for t, f in zip(forest.trees, forest.first)])


def route(rows: DataFrame, forest: Forest | Grids, dim: int, *, member: bool, query: bool, probes: int, coarse: bool, sent: list | None = None, cells: Cells | None = None) -> DataFrame:
    """``leaf, role, id, vector`` with a row for each leaf in which ``rows`` are members, are searched for, or both
    (role 1, 2, 3). Members are in their own leaf of each tree; ``probes`` leaves are searched. Vectors are bytes: floats
    as stored, or with ``coarse`` 8 bits a component, for candidates that are checked elsewhere. ``sent`` takes the broadcast,
    for callers that can tell when it is no longer needed. With ``Grids``, ``leaf`` is a task of leaves and ``role`` has the roles in
    all of them (``_leaves``). Rows of ``cells`` go to the cells' tasks, which are numbered after the leaves, and core rows to no leaf."""
    trees = len(forest.roots)
    if member and query and probes < trees:
        raise ValueError("members search at least their own leaf of each tree")
    shared = rows.sparkSession.sparkContext.broadcast((forest, cells))
    if sent is not None:
        sent.append(shared)
    grid = isinstance(forest, Grids)
    role = np.full(probes if query else trees, 2 if query else 1, np.int8)
    if member and query:
        role[:trees] = 3

    def run(batches):
        f, dense = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column(1), dim)
                u = unit(x)
                outside = np.arange(len(u))
                extra = ()
                if dense is not None:
                    core, *extra = dense.place(u, part.column(0).to_numpy(), (1 if member else 0) | (2 if query else 0))
                    outside = np.flatnonzero(~core)
                leaves = f.search(u[outside], len(role))
                vec = np.rint(u * (127 / np.maximum(np.abs(u).max(1, keepdims=True), 1e-30))).astype(np.int8) if coarse else x
                i, j = np.nonzero(leaves >= 0)
                leaf, roles = leaves[i, j], role[j]
                if grid:
                    i, leaf, roles = _once(i, f.task[leaf], roles.astype(np.int32) << 3 + 2 * f.place[leaf])
                i = outside[i]
                if extra:
                    i, leaf, roles = np.r_[i, extra[0]], np.r_[leaf, f.first[-1] + extra[1]], np.r_[roles, extra[2]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf.astype(np.int32)), pa.array(roles.astype(np.int32 if grid else np.int8)), part.column(0).take(pa.array(i)), packed(vec[i])],
                    names=["leaf", "role", "id", "vector"])

    return rows.select("id", "vector").mapInArrow(run, f"leaf int, role {'int' if grid else 'byte'}, id long, vector binary")


def _once(i: np.ndarray, task: np.ndarray, roles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's tasks once, with its roles in all their leaves."""
    order = np.lexsort((task, i))
    i, task, roles = i[order], task[order], roles[order]
    new = np.flatnonzero(np.r_[np.ones(min(len(i), 1), bool), (i[1:] != i[:-1]) | (task[1:] != task[:-1])])
    return i[new], task[new], np.bitwise_or.reduceat(roles, new) if len(new) else roles


_FOUND = "id long, c array<int>, b array<long>"


def search_leaves(routed: DataFrame, dim: int, k: int, min_cos: float, *, slack: float = 1e-4, leaf_rows: int = LEAF_ROWS, whole: bool = False, back: bool = False) -> DataFrame:
    """``id, c, b``: each search's ``k`` best members of a leaf, as -cosines in millionths and ids. With 8-bit vectors the
    cosines are approximate and ``slack`` should say by how much. With ``whole`` no leaf is split, whatever
    it holds. With ``back`` a member that isn't searched for beside a search that found it gets the search in its own list."""

    def run(table: pa.Table) -> pa.Table:
        role = table.column("role").to_numpy()
        ids = table.column("id").to_numpy()
        raw = matrix(table.column("vector"), dim)
        got_id, got_c, got_b, ends = [], [], [], [0]
        for own, members, asks in _leaves(role) if whole else _sides(role, _parts(unit(raw), 2 * leaf_rows)):
            if not len(members) or not len(asks):
                continue
            um = unit(raw[members])
            step = min(256, max(16, AT_ONCE // len(members)))
            for at in range(0, len(asks), step):
                q = asks[at : at + step]
                s = unit(raw[q]) @ um.T
                s[ids[q][:, None] == ids[members][None, :]] = -2
                many = (s >= min_cos - slack).sum(1)
                wide = min(int(many.max(initial=0)), k + 6, len(members))
                if not wide:
                    continue
                some = np.flatnonzero(many)
                s = s[some]
                top = np.argpartition(-s, wide - 1, axis=1)[:, :wide] if wide < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(some), 1))
                near = np.take_along_axis(s, top, 1)
                ok = near >= min_cos - slack
                if slack <= 1e-3 and wide == k + 6 < len(members):  # more may tie with the k-th than were taken
                    bar = np.partition(near, wide - k, axis=1)[:, wide - k]
                    crowd = np.flatnonzero((near.min(1) >= bar - TIED) & ok.all(1))
                    if len(crowd):
                        top[crowd, :k] = _best_of_ties(raw, ids, q[some[crowd]], members, k)
                        ok[crowd, k:] = False
                r, c = np.nonzero(ok)
                left, right = q[some[r]], members[top[r, c]]
                cos = exact_cosines(raw[left], raw[right]) if slack <= 1e-3 else np.take_along_axis(s, top, 1)[ok]
                micro = np.rint(cos * 1e6).astype(np.int64)
                good = micro >= round((min_cos - (slack if slack > 1e-3 else 0)) * 1e6)
                r, micro, b = r[good], micro[good], ids[right[good]]
                order = np.lexsort((b, -micro, r))
                r, micro, b = r[order], micro[order], b[order]
                place = np.arange(len(r)) - np.searchsorted(r, r)
                keep = place < k
                r, micro, b = r[keep], micro[keep], b[keep]
                who, count = np.unique(r, return_counts=True)
                asked = ids[q[some[who]]]
                got_id.append(asked)
                got_c.append(-micro)
                got_b.append(b)
                ends.extend((ends[-1] + np.cumsum(count)).tolist())
                if back:
                    far = np.flatnonzero(np.repeat(own[q[some[who]]] == 2, count))
                    far = far[np.argsort(b[far], kind="stable")]
                    others, count_b = np.unique(b[far], return_counts=True)
                    got_id.append(others)
                    got_c.append(-micro[far])
                    got_b.append(np.repeat(asked, count)[far])
                    ends.extend((ends[-1] + np.cumsum(count_b)).tolist())
        cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        ends = pa.array(ends, pa.int32())
        return pa.table({"id": pa.array(cat(got_id)), "c": pa.ListArray.from_arrays(ends, pa.array(cat(got_c).astype(np.int32))),
                         "b": pa.ListArray.from_arrays(ends, pa.array(cat(got_b)))})

    return routed.groupBy("leaf").applyInArrow(run, _FOUND)


def _sides(role: np.ndarray, parts):
    """Roles, members and searches of each part."""
    for rows in parts:
        yield role, rows[(role[rows] & 1) > 0], rows[(role[rows] & 2) > 0]


def _leaves(role: np.ndarray):
    """Roles, members and searches of each leaf of a task. The leaf at place p of a task of ``Grids`` has the roles in bits 3 + 2p and
    4 + 2p; the lower three are those of a cell's task."""
    if (role < 8).all():
        for members, asks in _blocks(role):
            yield role, members, asks
        return
    for place in range(TOGETHER):
        own = role >> 3 + 2 * place & 3
        yield own, np.flatnonzero(own & 1), np.flatnonzero(own & 2)


def _blocks(role: np.ndarray):
    """Members and searches of a cell's task: all against all in one block, each against the other in two."""
    one, two = np.flatnonzero(role < 4), np.flatnonzero(role >= 4)
    for a, b in ((one, two), (two, one)) if len(two) else ((one, one),):
        yield a[(role[a] & 1) > 0], b[(role[b] & 2) > 0]


def _best_of_ties(raw: np.ndarray, ids: np.ndarray, asks: np.ndarray, members: np.ndarray, k: int) -> np.ndarray:
    """Places in ``members`` of the ``k`` best of each search by cosine in millionths (double precision) and smaller id."""
    def double(rows):
        x = raw[rows].astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    n, m = len(members), double(members)
    rank = np.empty(n, np.int64)
    rank[np.argsort(ids[members], kind="stable")] = np.arange(n)
    out = np.empty((len(asks), k), np.int64)
    for s in range(0, len(asks), 32):
        q = asks[s : s + 32]
        micro = np.rint(double(q) @ m.T * 1e6).astype(np.int64)
        micro[ids[q][:, None] == ids[members][None, :]] = -2_000_000
        out[s : s + 32] = np.argpartition(rank - micro * n, k - 1, axis=1)[:, :k]
    return out


def _parts(u: np.ndarray, most: int):
    """Row numbers of a leaf, split further by a tree of its own if the leaf has outgrown ``most``."""
    if len(u) <= most:
        yield np.arange(len(u))
        return
    tree = fit_tree(u, most // 2, 11)
    forest = Forest([tree])
    leaf = np.concatenate([forest.search(u[i : i + 4096], 1)[:, 0] for i in range(0, len(u), 4096)])
    order = np.argsort(leaf, kind="stable")
    yield from np.split(order, np.cumsum(np.bincount(leaf, minlength=tree.leaves))[:-1])


def exact_cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row in double precision from stored components."""
    out = np.empty(len(a))
    for i in range(0, len(a), 8192):
        x, y = a[i : i + 8192].astype(np.float64), b[i : i + 8192].astype(np.float64)
        out[i : i + 8192] = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
    return out


def merge_lists(found: DataFrame, k: int) -> DataFrame:
    """``id, near``: the ``k`` best over all leaves of an id (at most probes * k entries come together)."""
    both = F.arrays_zip(F.flatten(F.collect_list("c")), F.flatten(F.collect_list("b"))).cast("array<struct<c:int,b:long>>")
    return found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(both)), 1, k).alias("near"))
