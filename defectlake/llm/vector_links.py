"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors are one point with a multiplicity. Points lie on the unit sphere, where a cosine is a distance. A tree over
a bounded sample gives every point its cell, cells lie in the tree's order and are cut into blocks of a few thousand
points, and each block gets a cover tree of its own: nested levels whose radii halve, every node with the true radius of
what it covers. Above the blocks lies a small tree of groups, again with true radii.

Two trees are traversed together. A pair of nodes ends where their distance less both radii is above the threshold (no
pair of their points is linked), or where their distance plus both radii is below it (all pairs are), and is else replaced
by the pairs of their children. Upper nodes meet by equi-joins on the parent, level by level; the surviving pairs of blocks
are traversed by tasks. A task returns for each point the number of its links and one point that it is linked to by a path,
so the links of a dense group are counted without being listed. Distances close to a bound are not trusted: points
are then compared by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from defectlake.llm.common import arrow_map, ragged_index, store
from defectlake.llm.near_dup import components
from defectlake.scale import HEAVY_ROWS, skewed_lookup

COSINE = 0.95
#: points of a block, about
BLOCK = 8192
#: vectors of the sample that gives the cells; the bound on what comes to the driver
SAMPLE = 4096
#: nodes below one upper node that has no blocks below it
FAN_OUT = 16
#: distances within this of a bound are decided by the cosine itself
MARGIN = 1e-6
#: node pairs that are worked on at once, one by one and as a product of matrices
CHUNK, BAND = 1 << 16, 1 << 21
#: a block's number is its task's times this and its place in the task, a point's its block's and its place in the block
BLOCKS, PLACES = 1 << 20, 1 << 16


def _bands(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Cut items into stretches of about ``limit`` in all, and one item at least."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield slice(start, stop)
        start = stop


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in doubles."""
    v = vectors.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def chord(cosine: np.ndarray) -> np.ndarray:
    """Distance of two points of the unit sphere."""
    return np.sqrt(np.maximum(2 - 2 * cosine, 0))


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the points ``x`` and the nodes of their cover tree, level after level.

    A node is (first point, one past its last point, first child, one past the last child); its centre is its first point
    in the given order. A child's centre is within half the radius of its parent's level, centres of one level
    that share a parent are further apart than their level's radius, and the first child has its parent's centre.
    Nodes of one point, and of points that are closer together than 1e-7, have no children.
    """
    order = np.arange(len(x))
    nodes = [[0, len(x), 0, 0]]
    level, radius = [0], 2.0
    while level:
        radius /= 2
        below = []
        for node in level:
            begin, end = nodes[node][:2]
            if end - begin == 1 or radius < 1e-7:
                continue
            members = order[begin:end]
            child = _net(x[members], radius)
            kids = int(child.max()) + 1
            order[begin:end] = members[np.argsort(child, kind="stable")]
            borders = begin + np.append(0, np.cumsum(np.bincount(child, minlength=kids)))
            nodes[node][2:] = len(nodes), len(nodes) + kids
            below += range(len(nodes), len(nodes) + kids)
            nodes += [[int(a), int(b), 0, 0] for a, b in zip(borders, borders[1:])]
        level = below
    return order, np.array(nodes, dtype=np.int64)


def _net(x: np.ndarray, radius: float, step: int = 128) -> np.ndarray:
    """Number of the centre that covers each point; centres are chosen in order, the first point is the first.

    The points of a centre keep their order, so a centre comes first among its points.
    """
    near = 1 - radius * radius / 2  # as a cosine
    child = np.full(len(x), -1, dtype=np.int64)
    n = 0
    rest = np.arange(len(x))
    while len(rest):
        some = rest[:step]
        among = x[some] @ x[some].T >= near
        centres: list[int] = []
        open_ = np.ones(len(some), dtype=bool)
        while open_.any():
            i = int(open_.argmax())
            taken = open_ & among[i]
            taken[i] = True
            child[some[taken]] = n + len(centres)
            open_ &= ~taken
            centres.append(i)
        others = rest[len(some) :]
        covered = x[others] @ x[some[centres]].T >= near
        hit = covered.any(axis=1)
        child[others[hit]] = n + covered[hit].argmax(axis=1)
        rest = others[~hit]
        n += len(centres)
    return child


def radii(x: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Largest distance of each node's points (``x`` in tree order) from its centre."""
    sizes = nodes[:, 1] - nodes[:, 0]
    found = np.zeros(len(nodes))
    wide = np.flatnonzero(sizes > 1)
    for band in _bands(sizes[wide], CHUNK):
        some = wide[band]
        at = ragged_index(nodes[some, 0], sizes[some])
        owner = np.repeat(nodes[some, 0], sizes[some])
        cosine = np.einsum("ij,ij->i", x[at], x[owner])
        found[some] = chord(np.minimum.reduceat(cosine, np.append(0, np.cumsum(sizes[some])[:-1])))
    return found


class Tree:
    """A block's points in tree order, their multiplicities, and the nodes with their radii."""

    def __init__(self, n: int, dim: int, points: bytes, weights: bytes, tree: bytes):
        kind = np.float32 if len(points) == 4 * n * dim else np.float64
        self.x = units(np.frombuffer(points, kind).reshape(n, dim))
        self.weights = np.frombuffer(weights, np.int64)
        self.before = np.append(0, np.cumsum(self.weights))
        self.nodes = np.frombuffer(tree, np.int64).reshape(-1, 4)
        self.radius = radii(self.x, self.nodes)

    def weight(self, node: np.ndarray) -> np.ndarray:
        return self.before[self.nodes[node, 1]] - self.before[self.nodes[node, 0]]

    def children(self, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children; a node without any stands for itself."""
        first, stop = self.nodes[node, 2], self.nodes[node, 3]
        leaf = first == stop
        return np.where(leaf, node, first), np.where(leaf, 1, stop - first)


class Forest:
    """Smallest linked point of each of some points; links are added in bulk."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.root[a], self.root[b]
            open_ = a != b
            a, b = np.minimum(a, b)[open_], np.maximum(a, b)[open_]
            np.minimum.at(self.root, b, a)
            while True:  # every chain ends at its root
                above = self.root[self.root]
                if (above == self.root).all():
                    break
                self.root = above


class Pair:
    """Dual traversal of two blocks' trees (or of one with itself, in which case every pair is met from both sides)."""

    def __init__(self, a: Tree, b: Tree, cosine: float):
        self.a, self.b, self.cosine = a, b, cosine
        self.distance = float(chord(np.array(cosine)))
        self.same = a is b
        # link counts as differences along the tree order, so a whole node is two numbers
        self.count = [np.zeros(len(t.x) + 1, dtype=np.int64) for t in (a, b)]
        self.forest = Forest(len(a.x) + (0 if self.same else len(b.x)))
        self.shift = 0 if self.same else len(a.x)

    def run(self) -> None:
        stack = [(np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            na, nb = stack.pop()
            (first_a, wide_a), (first_b, wide_b) = self.a.children(na), self.b.children(nb)
            size = wide_a * wide_b
            # many children against many: a product of matrices, band by band; few: pair by pair
            large = size >= CHUNK // 16
            for i in np.flatnonzero(large).tolist():
                columns = np.arange(first_b[i], first_b[i] + wide_b[i])
                band = max(1, BAND // len(columns))
                for low in range(0, int(wide_a[i]), band):
                    rows = np.arange(first_a[i] + low, first_a[i] + min(low + band, int(wide_a[i])))
                    cosine = self.a.x[self.a.nodes[rows, 0]] @ self.b.x[self.b.nodes[columns, 0]].T
                    reach = (self.distance + self.a.radius[rows])[:, None] + self.b.radius[columns][None, :]
                    at = np.flatnonzero(chord(cosine) <= reach + MARGIN)
                    for start in range(0, len(at), CHUNK):
                        r, c = np.divmod(at[start : start + CHUNK], len(columns))
                        self._judge(rows[r], columns[c], stack)
            few = np.flatnonzero(~large)
            for band in _bands(size[few], CHUNK):
                some = few[band]
                owner = np.repeat(some, size[some])
                within = ragged_index(np.zeros(len(some), np.int64), size[some])
                self._judge(first_a[owner] + within // wide_b[owner], first_b[owner] + within % wide_b[owner], stack)

    def _judge(self, na: np.ndarray, nb: np.ndarray, stack: list) -> None:
        """Count or drop node pairs, and put those that are neither on the stack."""
        a, b = self.a, self.b
        cosine = np.einsum("ij,ij->i", a.x[a.nodes[na, 0]], b.x[b.nodes[nb, 0]])
        far, spread = chord(cosine), a.radius[na] + b.radius[nb]
        inside = far + spread <= self.distance - MARGIN
        open_ = ~inside & (far - spread <= self.distance + MARGIN)
        leaves = (a.nodes[na, 2] == a.nodes[na, 3]) & (b.nodes[nb, 2] == b.nodes[nb, 3])
        self._linked(na[inside], nb[inside])
        last = open_ & leaves
        if last.any():
            single = (a.nodes[na, 1] - a.nodes[na, 0] == 1) & (b.nodes[nb, 1] - b.nodes[nb, 0] == 1)
            exact = last & single & (cosine >= self.cosine)
            self._linked(na[exact], nb[exact])
            for i, j in zip(na[last & ~single].tolist(), nb[last & ~single].tolist()):
                self._points(a.nodes[i, :2], b.nodes[j, :2])
        going = open_ & ~leaves
        if going.any():
            stack.append((na[going], nb[going]))

    def _linked(self, na: np.ndarray, nb: np.ndarray) -> None:
        """All points of the nodes are linked."""
        if not len(na):
            return
        spans = self.a.nodes[na], self.b.nodes[nb]
        for count, span, other in ((self.count[0], spans[0], self.b.weight(nb)), (self.count[1], spans[1], self.a.weight(na))):
            np.add.at(count, span[:, 0], other)
            np.add.at(count, span[:, 1], -other)
        for one, other, here, there in ((spans[0], spans[1], 0, self.shift), (spans[1], spans[0], self.shift, 0)):
            sizes = one[:, 1] - one[:, 0]
            for part in _bands(sizes, 16 * CHUNK):
                self.forest.link(ragged_index(one[part, 0], sizes[part]) + here, np.repeat(other[part, 0], sizes[part]) + there)

    def _points(self, span_a: np.ndarray, span_b: np.ndarray) -> None:
        """Compare the points of two nodes that can't be split any more."""
        for i in range(*span_a.tolist()):
            at = span_b[0] + np.flatnonzero(
                np.einsum("j,ij->i", self.a.x[i], self.b.x[span_b[0] : span_b[1]]) >= self.cosine
            )
            for count, place, other in (
                (self.count[0], np.full(len(at), i), self.b.weights[at]),
                (self.count[1], at, np.full(len(at), self.a.weights[i])),
            ):
                np.add.at(count, place, other)
                np.add.at(count, place + 1, -other)
            self.forest.link(np.full(len(at), i), at + self.shift)

    def links(self, block_a: int, block_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, links and a linked point of every point that has any; a point's own copies are among its links."""
        gids = np.append(block_a * PLACES + np.arange(len(self.a.x)), block_b * PLACES + np.arange(len(self.b.x)))
        if self.same:
            gids = gids[: len(self.a.x)]
            n = np.cumsum(self.count[0])[:-1]
        else:
            n = np.append(np.cumsum(self.count[0])[:-1], np.cumsum(self.count[1])[:-1])
        has = np.flatnonzero(n)
        return gids[has], n[has], gids[self.forest.root[has]]


def _packed(vector: np.ndarray) -> bytes:
    """Bytes of a vector behind their size: single precision where that holds all of it."""
    single = vector.astype(np.float32)
    return b"\4" + single.tobytes() if (single == vector).all() else b"\10" + vector.tobytes()


def _vector(key: bytes) -> np.ndarray:
    return np.frombuffer(key, np.float32 if key[0] == 4 else np.float64, offset=1).astype(np.float64)


def _dim(key: bytes) -> int:
    return (len(key) - 1) // key[0]


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector of each row as bytes; null if it can't be compared."""
    for batch in batches:
        lists = batch.column("vector")
        borders = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(borders[0], borders[-1] - borders[0]).to_numpy(zero_copy_only=False)
        flat = flat.astype(np.float64) + 0.0  # a null is not a number, -0.0 becomes 0.0
        borders = borders - borders[0]
        keys: list[bytes | None] = []
        for good, a, b in zip(lists.is_valid().to_pylist(), borders[:-1].tolist(), borders[1:].tolist()):
            v = flat[a:b]
            with np.errstate(over="ignore"):
                keys.append(_packed(v) if good and np.isfinite(v).all() and v.any() else None)
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary())], ["vec_id", "key"])


def _cells(sample: list[bytes]):
    """Where each point lies: dimension, place of the sample's nearest point in its tree, and ring around that."""
    by_dim: dict[int, np.ndarray] = {}
    for dim in {_dim(s) for s in sample}:
        x = units(np.stack([_vector(s) for s in sample if _dim(s) == dim]))
        by_dim[dim] = x[cover_tree(x)[0]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                keys = part.column("key").to_pylist()
                cell, ring = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int32)
                dims = np.array([_dim(k) for k in keys], dtype=np.int32)
                for dim in by_dim.keys() & set(dims.tolist()):
                    at = np.flatnonzero(dims == dim)
                    cosine = units(np.stack([_vector(keys[i]) for i in at.tolist()])) @ by_dim[dim].T
                    cell[at] = cosine.argmax(axis=1)
                    # radii halve from ring to ring
                    ring[at] = -np.floor(np.log2(np.maximum(chord(cosine.max(axis=1)), 2.0**-20)))
                columns = [*part.columns, pa.array(dims), pa.array(cell), pa.array(ring)]
                yield pa.RecordBatch.from_arrays(columns, [*part.schema.names, "dim", "cell", "ring"])

    return run


def _middle(x: np.ndarray) -> np.ndarray:
    """A centre for some points: the direction of their mean."""
    mean = x.mean(axis=0)
    length = np.sqrt(mean @ mean)
    return mean / length if length > 1e-6 else x[0]


_BUILT = (
    "row struct<block bigint, dim int, n int, weight bigint, centre binary, radius double, points binary, weights binary, "
    "tree binary>, members array<struct<key binary, gid bigint, rep bigint, weight bigint>>"
)


def _block(number: int, dim: int, keys: list[bytes], weights: list[int], reps: list[int | None]) -> pa.RecordBatch:
    raw = np.stack([_vector(k) for k in keys])
    x = units(raw)
    order, nodes = cover_tree(x)
    raw, centre = raw[order], _middle(x)
    single = raw.astype(np.float32) if all(k[0] == 4 for k in keys) else raw
    weight = np.array(weights, dtype=np.int64)[order]
    row = {
        "block": number, "dim": dim, "n": len(keys), "weight": int(weight.sum()), "centre": centre.tobytes(),
        "radius": float(chord((x @ centre).min())), "points": single.tobytes(), "weights": weight.tobytes(), "tree": nodes.tobytes(),
    }
    members = [
        {"key": keys[i], "gid": number * PLACES + place, "rep": reps[i], "weight": weights[i]} for place, i in enumerate(order.tolist())
    ]
    point = pa.struct([("key", pa.binary()), ("gid", pa.int64()), ("rep", pa.int64()), ("weight", pa.int64())])
    kind = pa.struct([
        ("block", pa.int64()), ("dim", pa.int32()), ("n", pa.int32()), ("weight", pa.int64()), ("centre", pa.binary()),
        ("radius", pa.float64()), ("points", pa.binary()), ("weights", pa.binary()), ("tree", pa.binary()),
    ])
    return pa.RecordBatch.from_arrays([pa.array([row], kind), pa.array([members], pa.list_(point))], ["row", "members"])


def _build(size: int):
    """Cut a sorted range of points into blocks of one dimension with a tree each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() * BLOCKS
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("dim", "key", "weight", "rep"))):
                if held and (row[0] != held[0][0] or len(held) == size):
                    dims, *columns = zip(*held)
                    yield _block(number, dims[0], *columns)
                    held, number = [], number + 1
                held.append(row)
        if held:
            dims, *columns = zip(*held)
            yield _block(number, dims[0], *columns)

    return run


def _group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Centre of each node's children, and the radius that covers all that theirs cover."""
    for batch in batches:
        rows = []
        for parts in batch.column("parts").to_pylist():
            x = np.stack([np.frombuffer(p["centre"]) for p in parts])
            centre = _middle(x)
            rows.append((centre.tobytes(), float((chord(x @ centre) + [p["radius"] for p in parts]).max())))
        columns = [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.float64())]
        names = ["dim", "node", "weight", "first"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, "centre", "radius"])


def _judge_upper(cosine: float):
    """Drop pairs of upper nodes without links; say of the others whether all their points are linked."""
    limit = float(chord(np.float64(cosine)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres = zip(*(batch.column(f"centre_{s}").to_pylist() for s in ("a", "b")))
            far = np.array([float(chord(np.frombuffer(x) @ np.frombuffer(y))) for x, y in centres], dtype=np.float64)
            spread = batch.column("radius_a").to_numpy() + batch.column("radius_b").to_numpy()
            keep = np.flatnonzero(far - spread <= limit + MARGIN)
            whole = (far + spread <= limit - MARGIN)[keep]
            columns = [batch.column(c).take(pa.array(keep)) for c in ("dim", "a", "b")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole)], ["dim", "a", "b", "whole"])

    return run


def _meet(blocks: DataFrame, cosine: float) -> tuple[DataFrame, list[tuple[int, DataFrame, DataFrame]]]:
    """Pairs of blocks that are left to traverse, and per level (shift, nodes, pairs of nodes whose points are all linked).

    A node's number is that of any block below it, shifted. Node pairs go down level by level from each dimension's root.
    """
    nodes = blocks.select(
        "dim", F.col("block").alias("node"), "weight", (F.col("block") * PLACES).alias("first"), "centre", "radius"
    )
    levels = [(0, nodes)]
    shift, step = 0, BLOCKS.bit_length() - 1
    while levels[-1][1].agg(F.max("node")).first()[0]:
        shift += step
        grouped = (
            levels[-1][1].withColumn("node", F.shiftright("node", step))
            .groupBy("dim", "node")
            .agg(
                F.sum("weight").alias("weight"), F.min("first").alias("first"),
                F.collect_list(F.struct("centre", "radius")).alias("parts"),
            )
        )
        fields = "dim int, node bigint, weight bigint, first bigint, centre binary, radius double"
        levels.append((shift, store(grouped.transform(arrow_map, _group, fields), "upper")))
        step = FAN_OUT.bit_length() - 1
    shift, top = levels[-1]
    pairs = top.select("dim", F.col("node").alias("a"), F.col("node").alias("b"))
    known: list[tuple[int, DataFrame, DataFrame]] = []
    above = shift
    for shift, nodes in reversed(levels):
        for side in ("a", "b"):
            own = nodes.select(
                "dim", F.shiftright("node", above - shift).alias(side), F.col("node").alias(f"node_{side}"),
                F.col("centre").alias(f"centre_{side}"), F.col("radius").alias(f"radius_{side}"),
            )
            pairs = pairs.join(own, ["dim", side])
        judged = store(
            pairs.where("node_a <= node_b")
            .select("dim", F.col("node_a").alias("a"), F.col("node_b").alias("b"), "centre_a", "centre_b", "radius_a", "radius_b")
            .transform(arrow_map, _judge_upper(cosine), "dim int, a bigint, b bigint, whole boolean"),
            "met",
        )
        known.append((shift, nodes.select("dim", "node", "weight", "first"), judged.where("whole").drop("whole")))
        pairs, above = judged.where("not whole").drop("whole"), shift
    return pairs, known


def _traverse(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("n", "dim", "points", "weights", "tree")
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column("a")[i].as_py(), batch.column("b")[i].as_py()
                one = Tree(*(batch.column(f"{c}_a")[i].as_py() for c in names))
                other = one if a == b else Tree(*(batch.column(f"{c}_b")[i].as_py() for c in names))
                pair = Pair(one, other, cosine)
                pair.run()
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in pair.links(a, b)], ["gid", "n", "root"])

    return run


def _whole_links(known: list[tuple[int, DataFrame, DataFrame]], blocks: DataFrame) -> DataFrame:
    """(gid, n, root) from pairs of nodes whose points are all linked, without listing the pairs of points."""
    found = None
    for shift, nodes, pairs in known:
        both = pairs.unionByName(pairs.where("a != b").select("dim", F.col("b").alias("a"), F.col("a").alias("b")))
        partner = nodes.select("dim", F.col("node").alias("b"), "weight", "first")
        sums = (
            both.join(partner, ["dim", "b"])
            .groupBy("dim", "a")
            .agg(F.sum("weight").alias("n"), F.min("first").alias("root"))
        )
        held = blocks.select(
            "dim", F.shiftright("block", shift).alias("a"), (F.col("block") * PLACES).alias("first"), F.col("n").alias("size")
        )
        points = held.join(sums, ["dim", "a"]).select(
            F.explode(F.sequence(F.col("first"), F.col("first") + F.col("size") - 1)).alias("gid"), "n", "root"
        )
        # two nodes whose points are all linked are joined by their first points
        ends = [nodes.select("dim", F.col("node").alias(s), F.col("first").alias(f"first_{s}")) for s in ("a", "b")]
        firsts = pairs.where("a != b").join(ends[0], ["dim", "a"]).join(ends[1], ["dim", "b"]).select(
            F.col("first_a").alias("gid"), F.lit(0).cast("bigint").alias("n"), F.col("first_b").alias("root")
        )
        both = points.unionByName(firsts)
        found = both if found is None else found.unionByName(both)
    return found


def vector_links(
    vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, sample: int = SAMPLE
) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row of ``vectors`` (vec_id, embedding).

    n_links counts the other rows whose cosine with this one's vector is ``cosine`` (above 0, below 1) or more,
    component_id is the smallest vec_id that links reach, kept says whether that is the row's own. Every pair is decided
    exactly, in double precision. A vector that is null, empty, zero or holds a null or a non-finite number links
    with nothing, nor do vectors of different lengths; such a row is its own component. Repeated rows are rows of their own and
    link with each other; a null vec_id is passed on, and counts as no id where another of its component has one. Other
    columns are not read. An empty table gives no rows. ``block`` is at most 65,536. At most ``sample`` vectors, those with
    the smallest hashes, come to the driver; they decide how points lie together and not what is linked.
    """
    rows = store(
        vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
        .transform(arrow_map, _keys, "vec_id bigint, key binary"),
        "vectors",
    )
    points = store(
        rows.where(F.col("key").isNotNull()).groupBy("key").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("rep")),
        "points",
    )
    lone = rows.where(F.col("key").isNull()).select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")
    )
    chosen = [bytes(r.key) for r in points.select("key").orderBy(F.xxhash64("key"), "key").limit(sample).collect()]
    if not chosen:
        return lone
    placed = points.transform(
        arrow_map, _cells(chosen), "key binary, weight bigint, rep bigint, dim int, cell int, ring int"
    )
    built = store(
        placed.repartitionByRange("dim", "cell", "ring", "key")
        .sortWithinPartitions("dim", "cell", "ring", "key")
        .transform(arrow_map, _build(block), _BUILT),
        "blocks",
    )
    blocks = built.select("row.*")
    pairs, known = _meet(blocks, cosine)
    for side in ("a", "b"):
        names = ("n", "dim", "points", "weights", "tree")
        own = blocks.select(F.col("block").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in names])
        pairs = pairs.join(own, side)
    traversed = pairs.transform(arrow_map, _traverse(cosine), "gid bigint, n bigint, root bigint")
    links = store(traversed.unionByName(_whole_links(known, blocks)), "links")
    counts = links.groupBy("gid").agg(F.sum("n").alias("n"))
    roots = components(links.select(F.col("gid").alias("a"), F.col("root").alias("b")))
    members = built.select(F.explode("members").alias("m")).select("m.*")
    joined = store(
        members.join(counts, "gid").join(roots, "gid", "left").withColumn("root", F.coalesce("root", "gid")), "joined"
    )
    least = store(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "least")
    found = store(
        joined.join(least, "root").select("key", (F.col("n") - 1).alias("n_links"), "component_id", "weight"), "found"
    )
    hot = store(found.where(F.col("weight") >= HEAVY_ROWS).select("key"), "hot")
    linked = skewed_lookup(rows.where(F.col("key").isNotNull()), found.drop("weight"), ["key"], ["vec_id"], "inner", hot)
    return linked.select(
        "vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept")
    ).unionByName(lone)


def op11_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op11_vector_links": op11_vector_links}

ORACLE_SQL = {
    "op11_vector_links": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT least.vec_id, (SELECT count(*) FROM links WHERE links.a = least.vec_id) AS n_links, component_id,
  least.vec_id = component_id AS kept
FROM least
"""
}
