"""Near-duplicate vectors by dual traversal of a cover tree.

Distances are angles. The tree has nested levels with halving radii (``RADII``): a node of a level is a vector with all vectors
assigned to it, each within the level's radius; the node's own vector is the first centre among its children. What bounds node pairs
is each node's measured radius, so a node of one vector has radius 0.

1. Equal vectors become one point with a weight. While a node has more than ``block`` points, a bounded sample of it elects centres
   and its points, dealt into chunks of about ``block`` by a hash, are assigned to them; what no centre covers elects
   centres of its own chunk. So no task gets a whole node, however hot. Small sibling nodes are packed into blocks of about ``block`` points;
   a node of the last level is cut into blocks by a hash.
2. The dual traversal starts at the pair (root, root) and goes down level by level, as a table of node pairs. A pair goes where even the nearest points are
   too far apart (``angle > limit + r1 + r2``); it counts whole where even the farthest are near (``angle + r1 + r2 <= limit``): only the
   weights are added then, and no pairs arise however large the group. Any other pair meets its children.
3. Each surviving pair of blocks meets in one task, which goes on with the levels that the blocks hold inside, down to exact cosines of points. It returns added
   weights and, for components, at most one edge a point.

The vectors of a block travel once for each surviving block pair. In data without structure (random directions in many dimensions) the bounds prune
little above the points, and the work is that of comparing blocks with blocks: n * n / 2 products.

Rows: vectors that are null, empty, zero or hold null, NaN or infinite components link with nothing, nor do vectors of different length; rows that
repeat a vec_id are vectors of their own. Rows with a null vec_id link with nothing: component_id is null and kept true. Ties
cannot arise (links are a threshold). Only vec_id and embedding are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from takeweave.llm.components import components
from takeweave.session import discard, written

COSINE = 0.9
#: Radii of the levels below the root: each half of the one above. The last one is under half of the limit of 25.8 degrees.
RADII = tuple(math.radians(d) for d in (90.0, 45.0, 22.5, 11.25))
BLOCK = 8192
SAMPLE = 512
#: Bounds are taken with this margin, so that rounding decides nothing but exact cosines.
MARGIN = 1e-9
_STRIP = 512
_GATHER = 50_000


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1.0, 1.0))


def net(u: np.ndarray, radius: float, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``u`` its centre (a row number) and the angle to it, at most ``radius``.

    The rows ``first`` are centres; each other row goes to the nearest of them if it is within the radius; what is left elects centres
    greedily in row order.
    """
    owner, near = np.full(len(u), -1), np.zeros(len(u))

    def assign(rows: np.ndarray, centres: np.ndarray) -> None:
        for at in range(0, len(rows), _STRIP):
            r = rows[at : at + _STRIP]
            dots = u[r] @ u[centres].T
            best = dots.argmax(axis=1)
            a = _angle(dots[np.arange(len(r)), best])
            ok = a <= radius
            owner[r[ok]], near[r[ok]] = centres[best[ok]], a[ok]

    owner[first] = first
    if len(first):
        assign(np.flatnonzero(owner < 0), first)
    left = np.flatnonzero(owner < 0)
    while len(left):
        some, rest = left[:256], left[256:]
        close = u[some] @ u[some].T >= math.cos(radius)
        free, chosen = np.ones(len(some), bool), []
        for i in range(len(some)):
            if free[i]:
                chosen.append(i)
                free &= ~close[i]
        centres = some[chosen]
        owner[centres] = centres
        assign(some[owner[some] < 0], centres)
        missed = some[owner[some] < 0]  # by rounding, at the very radius
        owner[missed] = missed
        assign(rest, centres)
        left = rest[owner[rest] < 0]
    return owner, near


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the length of ``x`` at the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]).astype(np.int32)


def _levels(u: np.ndarray, radii: tuple[float, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """An order of the rows in which every node is a run that begins with its centre, and the run bounds of each level."""
    owners = [np.zeros(len(u), np.int64)]
    for radius in radii:
        up, own = owners[-1], np.arange(len(u))
        order = np.argsort(up, kind="stable")
        bounds = _runs(up[order])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a > 1:
                rows = order[a:b]
                centre = np.flatnonzero(rows == up[rows[0]]) if len(owners) > 1 else np.zeros(1, np.int64)
                own[rows] = rows[net(u[rows], radius, centre)[0]]
        owners.append(own)
    here, keys = np.arange(len(u)), []
    for up, own in zip([*owners[1:], here][::-1], owners[::-1], strict=True):
        keys += [up, up != own]  # least significant first; a node's own centre leads its children
    order = np.lexsort(keys)
    return order, [_runs(own[order]) for own in owners[1:]]


def _block_task(radii: tuple[float, ...]):
    def run(points: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("pid")
        v = np.stack(points["v"].to_numpy())
        u = _unit(v)
        order, bounds = _levels(u, radii)
        mean = u.mean(axis=0)
        centre = u[0] if not np.abs(mean).max() > 1e-6 else _unit(mean[None])[0]
        small = v.astype(np.float32)
        v = small if (small == v).all() else v
        row = {
            "block": points["block"].iloc[0], "parent": points["parent"].iloc[0], "centre": centre, "radius": float(_angle(u @ centre).max()), "weight": int(points["m"].sum()), "rep": int(points["pid"].min()),
            "pids": points["pid"].to_numpy()[order], "ms": points["m"].to_numpy()[order], "bounds": [b.tolist() for b in bounds], "width": v.itemsize, "vec": v[order].tobytes(),
        }
        return pd.DataFrame([row])

    return run


_BLOCK_SCHEMA = "block string, parent string, centre array<double>, radius double, weight long, rep long, pids array<long>, ms array<long>, bounds array<array<int>>, width int, vec binary"


class _Block:
    """A block in a task: unit vectors, weights, and for each level the run bounds, radii and weights of its nodes; the last level is the points."""

    def __init__(self, row):
        self.pids, self.ms = np.asarray(row.pids), np.asarray(row.ms)
        v = np.frombuffer(row.vec, np.float32 if row.width == 4 else np.float64).reshape(len(self.pids), -1).astype(np.float64)
        self.u = _unit(v)
        n = len(self.u)
        self.bounds = [np.asarray(b) for b in row.bounds] + [np.arange(n + 1)]
        self.radii = []
        for b in self.bounds:
            centre = np.repeat(b[:-1], np.diff(b))
            a = np.where(centre == np.arange(n), 0.0, _angle(np.einsum("ij,ij->i", self.u, self.u[centre])))
            self.radii.append(np.maximum.reduceat(a, b[:-1]))
        total = np.concatenate([[0], np.cumsum(self.ms)])
        self.weights = [total[b[1:]] - total[b[:-1]] for b in self.bounds]
        self.kids = [np.searchsorted(low[:-1], b) for b, low in zip(self.bounds, self.bounds[1:], strict=False)]
        self.added = np.zeros(n + 1, np.int64)  # differences: a node's addition begins at its first point and ends after its last

    def add(self, level: int, nodes: np.ndarray, weights: np.ndarray) -> None:
        b = self.bounds[level]
        np.add.at(self.added, b[nodes], weights)
        np.add.at(self.added, b[nodes + 1], -weights)

    def joined(self, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each point of the nodes with its node's first point."""
        b, nodes = self.bounds[level], np.unique(nodes)
        size = b[nodes + 1] - b[nodes]
        first = np.repeat(b[nodes], size)
        return first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size), first


def _merge(labels: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels (each the least row of its set) after joining the sets of ``x`` and ``y`` pairwise."""
    while True:
        a, b = labels[x], labels[y]
        differ = a != b
        if not differ.any():
            return labels
        x, y, a, b = x[differ], y[differ], a[differ], b[differ]
        np.minimum.at(labels, np.maximum(a, b), np.minimum(a, b))
        while (labels != labels[labels]).any():
            labels = labels[labels]


def _expand(kids_a: np.ndarray, kids_b: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the children of i and j, some ``_GATHER`` at a time."""
    na, nb = kids_a[i + 1] - kids_a[i], kids_b[j + 1] - kids_b[j]
    ends = np.cumsum(na * nb)
    total = int(ends[-1]) if len(ends) else 0
    for at in range(0, total, _GATHER):
        k = np.arange(at, min(at + _GATHER, total))
        of = np.searchsorted(ends, k, "right")
        k = k - (ends[of] - na[of] * nb[of])
        yield kids_a[i[of]] + k // nb[of], kids_b[j[of]] + k % nb[of]


def _pair_task(limit: float, cosine: float):
    """Dual traversal inside a pair of blocks (or a block with itself, where each ordered pair of points counts for its first)."""

    def run(sides: pd.DataFrame) -> pd.DataFrame:
        blocks = [_Block(r) for r in sides.sort_values("side").itertuples()]
        a, b = blocks[0], blocks[-1]
        shift = 0 if a is b else len(a.u)
        labels = np.arange(shift + len(b.u))
        last = len(a.bounds) - 1

        def count(level: int, i: np.ndarray, j: np.ndarray) -> None:
            nonlocal labels
            a.add(level, i, b.weights[level][j])
            if a is not b:
                b.add(level, j, a.weights[level][i])
            for x, y in (a.joined(level, i), tuple(p + shift for p in b.joined(level, j)), (a.bounds[level][i], b.bounds[level][j] + shift)):
                labels = _merge(labels, x, y)

        def down(level: int, i: np.ndarray, j: np.ndarray) -> None:
            """Pairs of nodes that the bounds of ``level`` left open, to the next level."""
            for x, y in _expand(a.kids[level], b.kids[level], i, j):
                settle(level + 1, x, y, np.einsum("ij,ij->i", a.u[a.bounds[level + 1][x]], b.u[b.bounds[level + 1][y]]))

        def settle(level: int, i: np.ndarray, j: np.ndarray, dots: np.ndarray) -> None:
            if level == last:
                near = dots >= cosine
                count(level, i[near], j[near])
                return
            angle, reach = _angle(dots), a.radii[level][i] + b.radii[level][j]
            near = angle + reach <= limit - MARGIN
            count(level, i[near], j[near])
            left = ~near & (angle - reach <= limit + MARGIN)
            down(level, i[left], j[left])

        ca, cb = a.u[a.bounds[0][:-1]], b.u[b.bounds[0][:-1]]
        ra, rb = a.radii[0], b.radii[0]
        # dot - cos(limit + ra + rb) as one product: the cosine of the sum is a product of two columns.
        right = np.column_stack([cb, np.cos(rb), np.sin(rb)]).T
        for at in range(0, len(ca), _STRIP):
            r = ra[at : at + _STRIP] + limit + MARGIN
            over = np.column_stack([ca[at : at + _STRIP], -np.cos(r), np.sin(r)]) @ right
            i, j = np.nonzero(over >= -MARGIN)
            i += at
            for k in range(0, len(i), _GATHER):
                x, y = i[k : k + _GATHER], j[k : k + _GATHER]
                settle(0, x, y, np.einsum("ij,ij->i", ca[x], cb[y]))
        pids = a.pids if a is b else np.concatenate([a.pids, b.pids])
        added = np.concatenate([np.cumsum(x.added)[:-1] for x in ([a] if a is b else [a, b])])
        some = (added > 0) | (labels != np.arange(len(labels)))
        return pd.DataFrame({"pid": pids[some], "added": added[some], "to": pids[labels[some]]})

    return run


def _elect_task(radius: float):
    def run(sample: pd.DataFrame) -> pd.DataFrame:
        sample = sample.sort_values("pid")
        u = _unit(np.stack(sample["v"].to_numpy()))
        owner, _ = net(u, radius, np.flatnonzero(sample["pid"].to_numpy() == sample["centre"].iloc[0]))
        return sample[["node", "pid", "v"]].iloc[np.unique(owner)]

    return run


def _assign_task(radius: float):
    def run(points: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        points = points.sort_values("pid").reset_index(drop=True)
        if not len(points):
            return pd.DataFrame({"pid": [], "m": [], "v": [], "path": [], "centre": [], "angle": []})
        extra = centres[~centres["pid"].isin(points["pid"])].sort_values("pid")
        pids = np.concatenate([points["pid"].to_numpy(), extra["pid"].to_numpy()])
        u = _unit(np.stack([*points["v"], *extra["v"]]))
        owner, near = net(u, radius, np.flatnonzero(np.isin(pids, centres["pid"].to_numpy())))
        n = len(points)
        return points[["pid", "m", "v", "path"]].assign(centre=pids[owner[:n]], angle=near[:n])

    return run


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, v) of every row: v is null where a vector links with nothing, and scaled by a power of two, which keeps its direction exactly."""
    e = table["embedding"].cast("array<double>")
    top = F.array_max(F.transform(e, F.abs))
    good = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (top > 0) & table["vec_id"].isNotNull()
    scale = F.pow(F.lit(2.0), F.least(-F.floor(F.log2(top)), F.lit(1000)))
    return table.select(table["vec_id"].cast("long").alias("vec_id"), F.when(good, F.transform(e, lambda x: x * scale)).alias("v"))


def _pieces(count: Column, block: int) -> Column:
    return F.ceil(count / F.lit(block))


def _tree(points: DataFrame, radii: tuple[float, ...], block: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """(inner nodes, points with their block and its parent). Nodes have an id of level and centre, and the path of their ancestors."""
    roots = points.groupBy(F.size("v").alias("d")).agg(F.min("pid").alias("centre"))
    here = points.join(roots, F.size("v") == F.col("d")).select("pid", "m", "v", F.array().cast("array<string>").alias("path"), "centre", F.lit(math.pi).alias("angle"))
    nodes, done = None, None
    for level in range(len(radii) + 1):
        here = written(here.withColumn("node", F.concat_ws(":", F.lit(level), "centre")), f"tree-{level}")
        size = here.groupBy("node").agg(F.count("*").alias("n"), F.max("angle").alias("radius"), F.sum("m").alias("weight"), F.min("pid").alias("rep"), F.first("path").alias("path"))
        big = size.where(F.col("n") > block) if level else size
        centres = here.where("pid = centre").select("node", F.col("v").alias("centre"))
        inner = written(big.join(centres, "node").select("node", F.element_at("path", -1).alias("parent") if level else F.lit(None).cast("string").alias("parent"), "path", "centre", "radius", "weight", "rep", "n"), f"nodes-{level}")
        nodes = inner if nodes is None else nodes.unionByName(inner)
        if level:
            # Small siblings share blocks, by a hash of the node, so that a node stays in one.
            small = size.where(F.col("n") <= block).select("node", "n", F.element_at("path", -1).alias("parent"))
            room = small.groupBy("parent").agg(_pieces(F.sum("n"), block).alias("k"))
            bins = small.join(room, "parent").select("node", "parent", F.concat_ws(":", F.lit("s"), "parent", F.pmod(F.xxhash64("node"), F.col("k"))).alias("block"))
            packed = here.join(bins, "node").select("pid", "m", "v", "parent", "block")
            done = packed if done is None else done.unionByName(packed)
        size = inner.select("node", "n")
        if level == len(radii) or (level and inner.isEmpty()):
            cut = F.concat_ws(":", F.lit("c"), "node", F.pmod(F.xxhash64("pid"), _pieces(F.col("n"), block)))
            done_here = here.join(size, "node").select("pid", "m", "v", F.col("node").alias("parent"), cut.alias("block"))
            return nodes, written(done.unionByName(done_here), "placed")
        open_points = here.join(size, "node")
        chosen = open_points.where((F.pmod(F.xxhash64("pid", F.lit(level)), F.col("n")) < sample) | (F.col("pid") == F.col("centre")))
        elected = chosen.select("node", "pid", "v", "centre").groupBy("node").applyInPandas(_elect_task(radii[level]), "node string, pid long, v array<double>")
        dealt = open_points.withColumn("salt", F.pmod(F.xxhash64("pid", F.lit(-1 - level)), _pieces(F.col("n"), block))).select("node", "salt", "pid", "m", "v", F.concat("path", F.array("node")).alias("path"))
        told = elected.join(size, "node").select("node", F.explode(F.sequence(F.lit(0).cast("long"), _pieces(F.col("n"), block) - 1)).alias("salt"), "pid", "v")
        both = dealt.groupBy("node", "salt").cogroup(told.groupBy("node", "salt"))
        here = both.applyInPandas(_assign_task(radii[level]), "pid long, m long, v array<double>, path array<string>, centre long, angle double")
    raise AssertionError


def _traverse(items: DataFrame, limit: float) -> tuple[DataFrame, DataFrame]:
    """(pairs of items that count whole, pairs of blocks that stay open). A pair is (a, b) with a <= b."""
    slim = items.select("item", "parent", "centre", "radius", "is_block")
    kids = slim.where("parent is not null").select("parent", F.col("item").alias("kid")).union(slim.where("is_block").select("item", "item"))
    pairs = slim.where("parent is null").select(F.col("item").alias("a"), F.col("item").alias("b"))
    whole, open_blocks = None, None
    while True:
        at = pairs.join(slim.select(F.col("item").alias("a"), F.col("centre").alias("ca"), F.col("radius").alias("ra"), F.col("is_block").alias("ba")), "a")
        at = at.join(slim.select(F.col("item").alias("b"), F.col("centre").alias("cb"), F.col("radius").alias("rb"), F.col("is_block").alias("bb")), "b")
        dot = _dot(F.col("ca"), F.col("cb")) / F.sqrt(_dot(F.col("ca"), F.col("ca")) * _dot(F.col("cb"), F.col("cb")))
        angle = F.when(F.col("a") == F.col("b"), 0.0).otherwise(F.acos(F.least(F.greatest(dot, F.lit(-1.0)), F.lit(1.0))))
        reach = F.col("ra") + F.col("rb")
        state = F.when(angle - reach > limit + MARGIN, 0).when(angle + reach <= limit - MARGIN, 1).when(F.col("ba") & F.col("bb"), 2).otherwise(3)
        at = written(at.select("a", "b", state.alias("state")).where("state > 0"), "node-pairs")
        more, blocks = at.where("state = 1").select("a", "b"), at.where("state = 2").select("a", "b")
        whole = more if whole is None else whole.union(more)
        open_blocks = blocks if open_blocks is None else open_blocks.union(blocks)
        left = at.where("state = 3")
        if left.isEmpty():
            return whole, open_blocks
        met = left.join(kids.toDF("a", "x"), "a").join(kids.toDF("b", "y"), "b").where("a <> b or x <= y")
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _slots(pairs: DataFrame, n: int) -> int:
    return max(int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * n, 20_000))


def near_vectors(table: DataFrame, cosine: float = COSINE, radii: tuple[float, ...] = RADII, block: int = BLOCK, sample: int = SAMPLE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``table(vec_id, embedding, ...)``.

    n_links counts the other rows whose cosine is at least ``cosine`` (not negative), component_id is the least vec_id that links reach.
    """
    limit = math.acos(cosine)
    if not 0 <= cosine <= 1 or radii[1] > math.pi / 4 + MARGIN:
        raise ValueError("cosine lies in [0, 1], and radii from the second on are 45 degrees at most")
    rows = written(vectors(table).withColumn("d1", F.xxhash64("v")).withColumn("d2", F.xxhash64(F.lit(1), "v")), "vectors")
    points = written(rows.where("v is not null").groupBy("d1", "d2", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("m")).withColumn("point", F.monotonically_increasing_id()), "points")
    nodes, placed = _tree(points.select(F.col("point").alias("pid"), "m", "v"), radii, block, sample)
    blocks = written(placed.groupBy("block").applyInPandas(_block_task(radii[1:]), _BLOCK_SCHEMA), "blocks")
    inner = nodes.select(F.col("node").alias("item"), "parent", "path", "centre", "radius", "weight", "rep", F.lit(False).alias("is_block"))
    paths = nodes.select(F.col("node").alias("parent"), F.concat("path", F.array("node")).alias("path"))
    outer = blocks.join(paths, "parent").select(F.col("block").alias("item"), "parent", "path", "centre", "radius", "weight", "rep", F.lit(True).alias("is_block"))
    items = written(inner.unionByName(outer), "items")
    whole, open_blocks = _traverse(items, limit)
    open_blocks = written(open_blocks, "open-blocks")
    sides = open_blocks.select("a", "b", F.lit(0).alias("side"), F.col("a").alias("block")).union(open_blocks.where("a <> b").select("a", "b", F.lit(1), "b"))
    data = sides.join(blocks.select("block", "pids", "ms", "bounds", "width", "vec"), "block").repartition(_slots(open_blocks, open_blocks.count()), "a", "b")
    found = written(data.groupBy("a", "b").applyInPandas(_pair_task(limit, cosine), "pid long, added long, to long"), "found")

    light = items.select("item", "weight", "rep")
    ends = whole.join(light.toDF("a", "wa", "pa"), "a").join(light.toDF("b", "wb", "pb"), "b")
    sums = ends.select(F.col("a").alias("item"), F.col("wb").alias("w")).union(ends.where("a <> b").select("b", "wa")).groupBy("item").agg(F.sum("w").alias("w"))
    of_block = items.where("is_block").select(F.col("item").alias("block"), F.explode(F.concat("path", F.array("item"))).alias("item"))
    by_block = of_block.join(sums, "item").join(light, "item").groupBy("block").agg(F.sum("w").alias("added"), F.collect_set("rep").alias("reps"))
    in_whole = written(placed.select("pid", "block").join(by_block, "block").select("pid", "added", "reps"), "in-whole")
    added = found.select("pid", "added").union(in_whole.select("pid", "added")).groupBy("pid").agg((F.sum("added") - 1).alias("n_links"))
    links = found.select("pid", "to").union(in_whole.select("pid", F.explode("reps"))).union(ends.select("pa", "pb"))
    labels = written(components(links.toDF("a", "b")), "labels")
    named = points.join(labels.withColumnRenamed("node", "point"), "point", "left").select("d1", "d2", "point", F.coalesce("component", "point").alias("c"), "least")
    heads = named.groupBy("c").agg(F.min("least").alias("component_id"))
    out = named.join(heads, "c").join(added.withColumnRenamed("pid", "point"), "point").select("d1", "d2", "n_links", "component_id")
    full = rows.join(out, ["d1", "d2"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return full.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept FROM v JOIN c ON c.a = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""
