"""Near-duplicate vectors by dual traversal of cover trees.

Equal vectors of a label form one class with a multiplicity, and a class is a
node.  A *problem* is a set of own nodes, all whose pairs are wanted, and of
visitors, wanted against the own ones only.  A label starts as one problem;
problems of more than ``2 BLOCK`` own nodes are cut before anything is compared,
level by level, by the top of a cover tree that is fitted on a bounded sample of
their own nodes (a nested net by farthest-first traversal):

* A *core* is a ball of half the threshold's distance around a dense spot.  All
  its nodes link with each other, so they are counted, never paired; only nodes
  outside it, but within the threshold of the ball, visit it.
* Other nodes live in the cell of their nearest pivot.  A node visits the cell of
  an earlier pivot only if the hyperplane between both pivots is within the
  threshold's distance of it; triangle inequality proves that no link is lost.
* Where the sample shows that pivots would part nothing (a hot cell), nodes are
  dealt by hash to a grid of blocks.

A problem of bounded size then gets a cover tree: nested levels whose covering
radii halve, with the true radius of each node.  Visitors stream past in trees of
``BLOCK``.  The traversal drops a pair of tree nodes when their distance less both
radii exceeds the threshold, and accepts all their pairs at once when distance
plus radii is within it; what stays undecided is split, down to leaves whose
members are all compared in double precision.

Every problem returns for each node its number of links and one node that it
reaches: a row for each node and problem, never a row for each pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, partitions, prepare
from .graph import components
from .simhash import local_forest, mix64
from .vectors import matrix, valid

#: Own nodes of a problem that are aimed at; visitors of one tree.
BLOCK = 1024
#: Tree nodes of so many members or fewer aren't divided.
LEAF = 32
#: Bounds decide only beyond this margin, above all rounding of distances.
MARGIN = 1e-6
#: Own nodes that a level's net is fitted on, its pivots and cores at most.
SAMPLE = 1024
PIVOTS = 64
CORES = 16
#: Nodes of a problem that one group cuts; visitors that one task meets.
CHUNK = 8192
VISITORS = 32 * BLOCK
#: Pairs of a kernel.
PAIRS = 1 << 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between unit vectors."""
    gap = a @ b.T
    gap *= -2.0
    gap += 2.0
    return np.sqrt(np.maximum(gap, 0.0, out=gap), out=gap)


class CoverTree:
    """Nodes as arrays: centre, true radius, members order[start:end], children."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.order = np.arange(len(points))
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.children: list[np.ndarray] = []
        if len(points):
            self._grow(distances(points, points))
        self.at, self.reach = np.array(self.centre, dtype=np.int64), np.array(self.radius)
        self.leaf = np.array([not len(c) for c in self.children], dtype=bool)

    def _node(self, away: np.ndarray, members: np.ndarray, start: int) -> int:
        centre = int(members[0])  # a child keeps its centre on all levels below: nested
        self.order[start : start + len(members)] = members
        self.centre.append(centre)
        self.radius.append(float(away[centre, members].max()) if len(members) > 1 else 0.0)
        self.start.append(start)
        self.end.append(start + len(members))
        self.children.append(np.zeros(0, dtype=np.int64))
        return len(self.centre) - 1

    def _grow(self, away: np.ndarray) -> None:
        todo = [self._node(away, self.order.copy(), 0)]
        while todo:
            node = todo.pop()
            at, radius = self.start[node], self.radius[node]
            if self.end[node] - at <= LEAF or radius <= MARGIN:
                continue
            left, made = self.order[at : self.end[node]].copy(), []
            while len(left):  # a net: centres more than half the radius apart, with what they cover
                near = away[left[0], left] <= radius / 2
                near[0] = True
                part = left[near]
                made.append(self._node(away, part, at))
                at += len(part)
                left = left[~near]
            self.children[node] = np.array(made)
            todo += made

    def below(self, node: int) -> np.ndarray:
        return self.children[node] if len(self.children[node]) else np.array([node])

    def members(self, node: int) -> np.ndarray:
        return self.order[self.start[node] : self.end[node]]


def dual(a: CoverTree, b: CoverTree, far: float, whole, single) -> None:
    """Calls whole(i, j) for members that all link, and single(i, j) for pairs
    that must be compared, as arrays of points of a and b."""
    if not len(a.points) or not len(b.points):
        return
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        kids, ky = a.below(x), b.below(y)
        for at in range(0, len(kids), 256):
            kx = kids[at : at + 256]
            gap = distances(a.points[a.at[kx]], b.points[b.at[ky]])
            reach = a.reach[kx][:, None] + b.reach[ky][None, :]
            i, j = np.nonzero(gap - reach <= far + MARGIN)
            inside = gap[i, j] + reach[i, j] <= far - MARGIN
            ends = a.leaf[kx[i]] & b.leaf[ky[j]]
            for u, v in zip(kx[i[inside]].tolist(), ky[j[inside]].tolist(), strict=True):
                whole(a.members(u), b.members(v))
            _compare(a, kx[i[ends & ~inside]], b, ky[j[ends & ~inside]], single)
            rest = ~ends & ~inside
            todo += list(zip(kx[i[rest]].tolist(), ky[j[rest]].tolist(), strict=True))


def _compare(a: CoverTree, x: np.ndarray, b: CoverTree, y: np.ndarray, single) -> None:
    """All members of leaves x with all of leaves y, in bounded chunks."""
    if not len(x):
        return
    start_a, start_b = np.array(a.start)[x], np.array(b.start)[y]
    n_b = np.array(b.end)[y] - start_b
    bounds = np.concatenate([[0], np.cumsum((np.array(a.end)[x] - start_a) * n_b)])
    for at in range(0, int(bounds[-1]), PAIRS):
        flat = np.arange(at, min(at + PAIRS, int(bounds[-1])))
        pair = np.searchsorted(bounds, flat, side="right") - 1
        inner = flat - bounds[pair]
        single(a.order[start_a[pair] + inner // n_b[pair]], b.order[start_b[pair] + inner % n_b[pair]])


class Points:
    """Nodes of a problem with their links so far."""

    def __init__(self, nodes: np.ndarray, copies: np.ndarray, vectors: np.ndarray):
        self.nodes, self.copies, self.vectors = nodes, copies, vectors
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.tree = CoverTree(vectors / self.norms[:, None])
        self.links = np.zeros(len(nodes), dtype=np.int64)
        self.label = np.arange(len(nodes))


def meet(own: Points, other: Points, least: float) -> None:
    """Links between two sets of points (or within one) are added to both.

    Labels of ``other`` become places in ``own`` where they are linked, and
    len(own) + place where not.
    """
    same, n = own is other, len(own.nodes)
    label = own.label if same else np.concatenate([own.label, n + other.label])
    shift = 0 if same else n

    def join(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal label
        u, v = label[i], label[j + shift]
        apart = u != v
        if apart.any():
            node, low = local_forest(u[apart], v[apart])
            to = np.arange(len(label))
            to[node] = low
            label = to[label]

    def whole(i: np.ndarray, j: np.ndarray) -> None:
        own.links[i] += other.copies[j].sum()
        if same:
            if i[0] == j[0]:  # nodes of one tree are disjoint or the same
                own.links[i] -= own.copies[i]
        else:
            other.links[j] += own.copies[i].sum()
        join(np.concatenate([i, np.full(len(j), i[0])]), np.concatenate([np.full(len(i), j[0]), j]))

    def single(i: np.ndarray, j: np.ndarray) -> None:
        if same:
            i, j = i[i != j], j[i != j]
        near = (own.vectors[i] * other.vectors[j]).sum(axis=1) / (own.norms[i] * other.norms[j]) >= least
        i, j = i[near], j[near]
        np.add.at(own.links, i, other.copies[j])
        if not same:
            np.add.at(other.links, j, own.copies[i])
        join(i, j)

    dual(own.tree, other.tree, reach_of(least), whole, single)
    own.label = label[:n]
    if not same:
        other.label = label[n:]


def reach_of(least: float) -> float:
    """The distance of unit vectors whose cosine is ``least``."""
    return math.sqrt(max(0.0, 2.0 - 2.0 * least))


def _solve(least: float):
    """Sorted by (pid, chunk, own first): links of the nodes of each problem."""
    schema = pa.schema([("node", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def points(parts: list[pa.RecordBatch]) -> Points:
        part = pa.Table.from_batches(parts)
        return Points(part.column("node").to_numpy(), part.column("copies").to_numpy(), matrix(part.column("vector")))

    def rows(of: Points, low: np.ndarray) -> pa.RecordBatch:
        told = (of.links > 0) | (low != of.nodes)
        return pa.RecordBatch.from_arrays([pa.array(of.nodes[told]), pa.array(of.links[told]), pa.array(low[told])], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, waiting, own = None, [], [], None

        def settle() -> None:
            nonlocal own, held
            if own is None and held:
                own = points(held)
                if held[0].column("inner")[0].as_py() and now[1] == 0:
                    meet(own, own, least)
                held = []

        def receive() -> Iterator[pa.RecordBatch]:
            nonlocal waiting
            if waiting:
                settle()
                if own is not None:
                    other = points(waiting)
                    meet(own, other, least)
                    yield rows(other, np.concatenate([own.nodes, other.nodes])[other.label])
                waiting = []

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal own
            yield from receive()
            settle()
            if own is not None:
                yield rows(own, own.nodes[np.minimum(own.label, len(own.nodes) - 1)])
            own = None

        for batch in batches:
            pid, chunk = batch.column("pid"), batch.column("chunk").to_numpy()
            stays = batch.column("own").to_numpy(zero_copy_only=False)
            names = np.asarray(pid.to_pylist(), dtype=object)
            cuts = np.flatnonzero((names[1:] != names[:-1]) | (chunk[1:] != chunk[:-1]) | (stays[1:] != stays[:-1])) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if start == end:
                    continue
                key = (names[start], int(chunk[start]))
                if key != now:
                    yield from finish()
                    now = key
                if stays[start]:
                    held.append(batch.slice(start, end - start))
                    continue
                for at in range(start, end, BLOCK):
                    waiting.append(batch.slice(at, min(BLOCK, end - at)))
                    if sum(w.num_rows for w in waiting) >= BLOCK:
                        yield from receive()
        yield from finish()

    return run


def _fit(least: float):
    """One problem's sampled own nodes -> its cores and pivots, or a grid."""
    far = reach_of(least)
    schema = pa.schema([("pid", pa.string()), ("kind", pa.string()), ("number", pa.int32()), ("side", pa.int32()), ("centre", pa.list_(pa.float64()))])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        pid, n = table.column("pid")[0].as_py(), table.column("n_own")[0].as_py()
        side = -(-n // BLOCK)
        out: list[tuple] = []
        if table.column("inner")[0].as_py():
            units = matrix(table.column("vector"))
            units /= np.sqrt((units * units).sum(axis=1))[:, None]
            cores, left = dense_spots(units, far, n)
            out += [(pid, "core", i, 0, c) for i, c in enumerate(cores)]
            chosen = net(left, far, min(PIVOTS, max(2, -(-n * len(left) // len(units) // BLOCK)))) if len(left) else []
            if parts_well(left, chosen, far, n * len(left) / len(units)):
                out += [(pid, "pivot", i, 0, left[c]) for i, c in enumerate(chosen)]
                side = 0
        if side:
            out.append((pid, "grid", 0, side, np.zeros(0)))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(schema.types)], schema=schema)

    return run


def dense_spots(units: np.ndarray, far: float, n: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Centres whose ball of half the threshold holds many nodes; the other nodes."""
    cores: list[np.ndarray] = []
    worth = max(3, BLOCK * len(units) // (2 * n))
    while len(cores) < CORES and len(units) >= worth:
        near = distances(units, units) <= far
        seed = int(near.sum(axis=1).argmax())
        centre = units[near[seed]].mean(axis=0)
        for _ in range(3):
            held = np.linalg.norm(units - centre, axis=1) <= far / 2 - MARGIN
            if held.any():
                centre = units[held].mean(axis=0)
        held = np.linalg.norm(units - centre, axis=1) <= far / 2 - MARGIN
        if held.sum() < worth:
            break
        cores.append(centre)
        units = units[~held]
    return cores, units


def net(units: np.ndarray, far: float, many: int) -> list[int]:
    """Farthest-first traversal: each prefix is a net whose radius its next point gives."""
    chosen, away = [0], np.linalg.norm(units - units[0], axis=1)
    while len(chosen) < many and away.max() > 2 * far:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(units - units[chosen[-1]], axis=1))
    return chosen


def visits(units: np.ndarray, pivots: np.ndarray, far: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, mask of cells within the threshold) of each vector."""
    score = units @ pivots.T
    home = score.argmax(axis=1)
    apart = np.linalg.norm(pivots[:, None] - pivots[None, :], axis=2)
    return home, score[np.arange(len(units)), home][:, None] - score <= far * apart[home] + MARGIN


def parts_well(units: np.ndarray, chosen: list[int], far: float, n: float) -> bool:
    """Whether pivots spread the nodes, with fewer copies than a grid would make."""
    if len(chosen) < 2:
        return False
    home, mask = visits(units, units[chosen], far)
    lower = (mask & (np.arange(len(chosen))[None, :] < home[:, None])).sum(axis=1).mean()
    return np.bincount(home).max() <= 0.8 * len(units) and lower <= max(0.5, n / BLOCK / 2)


def _cut(least: float):
    """A chunk of a problem's nodes and its net -> nodes of the problems below."""
    far = reach_of(least)

    def run(rows: pa.Table, model: pa.Table) -> pa.Table:
        if not rows.num_rows or not model.num_rows:
            return rows.slice(0, 0)
        pid, inner = rows.column("pid")[0].as_py(), rows.column("inner")[0].as_py()
        own, node = rows.column("own").to_numpy(zero_copy_only=False), rows.column("node").to_numpy()
        units = matrix(rows.column("vector"))
        units /= np.sqrt((units * units).sum(axis=1))[:, None]
        model = model.sort_by("number")
        kinds = np.asarray(model.column("kind").to_pylist())
        centres = model.column("centre").combine_chunks()
        core = np.full(len(own), -1)
        out: list[tuple[str, bool, np.ndarray, np.ndarray]] = []  # problem, inner, rows, own

        def put(name: str, within: bool, stays: np.ndarray, comes: np.ndarray) -> None:
            at = np.concatenate([np.flatnonzero(stays), np.flatnonzero(comes)])
            if len(at):
                out.append((name, within, at, np.arange(len(at)) < stays.sum()))

        spots = np.flatnonzero(kinds == "core")
        away = np.zeros((len(own), len(spots)))
        for k, spot in enumerate(spots.tolist()):
            away[:, k] = np.linalg.norm(units - np.array(centres[spot].as_py()), axis=1)
            core[own & (core < 0) & (away[:, k] <= far / 2 - MARGIN)] = k
        for k in range(len(spots)):
            fringe = (away[:, k] <= 1.5 * far + MARGIN) & (~own | (core < 0) | (core > k))
            put(f"{pid}/c{k}", False, core == k, fringe)
        at = np.flatnonzero(kinds == "pivot")
        if len(at):
            home, near = visits(units, np.array([centres[int(i)].as_py() for i in at]), far)
            for q in range(len(at)):
                put(f"{pid}/p{q}", True, own & (core < 0) & (home == q), near[:, q] & (~own | ((core < 0) & (home > q))))
        for i in np.flatnonzero(kinds == "grid").tolist():
            side = model.column("side")[i].as_py()
            salt = np.uint64(xxhash.xxh64_intdigest(pid))  # another deal on each level
            block = (mix64(node.view(np.uint64) ^ salt) % np.uint64(side)).astype(np.int64)
            for q in range(side):
                put(f"{pid}/g{q}", inner, own & (core < 0) & (block == q), ~own | (inner & (core < 0) & (block > q)))
        if not out:
            return rows.slice(0, 0)
        taken = rows.take(pa.array(np.concatenate([o[2] for o in out])))
        columns = {
            "pid": pa.array(np.repeat([o[0] for o in out], [len(o[2]) for o in out]).tolist(), pa.string()),
            "inner": pa.array(np.repeat([o[1] for o in out], [len(o[2]) for o in out])),
            "own": pa.array(np.concatenate([o[3] for o in out])),
        }
        return pa.table([columns[n] if n in columns else taken.column(n) for n in rows.column_names], names=rows.column_names)

    return run


def _problems(scratch: Scratch, todo: DataFrame, least: float) -> tuple[DataFrame, list[DataFrame]]:
    """Cuts problems until all are bounded: (their nodes, cores as node, pid, copies)."""
    done, cores = [], []
    while True:
        sizes = todo.groupBy("pid").agg(F.first("inner").alias("inner"), F.count_if("own").alias("n_own"), F.count_if(~F.col("own")).alias("n_visits"))
        sizes = scratch.put(sizes.filter((F.col("n_own") > 0) & (F.col("inner") | (F.col("n_visits") > 0))))
        small = sizes.filter(F.col("n_own") <= 2 * BLOCK).select("pid", F.greatest(F.lit(1), F.ceil(F.col("n_visits") / VISITORS)).cast("int").alias("chunks"))
        done.append(todo.join(small, "pid"))
        large = sizes.filter(F.col("n_own") > 2 * BLOCK).withColumn("chunks", F.ceil((F.col("n_own") + F.col("n_visits")) / CHUNK).cast("int"))
        if large.isEmpty():
            break
        named = [f.name for f in todo.schema.fields]
        mine = todo.join(large.select("pid", "n_own", "chunks"), "pid")
        rank = F.row_number().over(Window.partitionBy("pid").orderBy(F.xxhash64("node"), "node"))
        drawn = mine.filter("own").withColumn("rank", rank).filter(F.col("rank") <= SAMPLE).select("pid", "inner", "n_own", "node", "vector")
        model = scratch.put(drawn.groupBy("pid").applyInArrow(_fit(least), "pid string, kind string, number int, side int, centre array<double>"))
        dealt = mine.select(*named, F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int").alias("chunk"))
        model = model.join(large.select("pid", "chunks"), "pid").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")
        schema = dealt.schema
        todo = scratch.put(dealt.groupBy("pid", "chunk").cogroup(model.groupBy("pid", "chunk")).applyInArrow(_cut(least), schema).drop("chunk"))
        cores.append(todo.filter(F.col("own") & F.substring_index("pid", "/", -1).startswith("c")).select("pid", "node", "copies"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out, cores


def near_duplicates(rows: DataFrame, least: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label).

    Rows of one label (not null) link when their cosine is ``least`` or more; the
    result is exact.  Vectors that are null, zero or hold null or non-finite
    components, and rows without a label or vec_id, link with nothing.  Vectors
    of different lengths never link.  Rows with equal vectors link; a repeated
    row, or another vector with the same vec_id, is another vector.  Other
    columns are ignored.
    """
    spark = prepare(rows.sparkSession)
    scratch = Scratch(spark, "vector-dedup")
    each = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").alias("vector"))
    each = each.withColumns({"sound": valid("vector") & F.col("label").isNotNull() & F.col("vec_id").isNotNull(), "k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    each = each.withColumn("k2", F.when(F.col("sound"), F.col("k2")).otherwise(F.xxhash64("vec_id")))
    key = ["label", "k1", "k2"]
    classes = each.filter("sound").groupBy(*key).agg(F.min("vec_id").alias("low_id"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = scratch.put(classes.withColumn("node", F.monotonically_increasing_id()))
    sets = classes.groupBy("label", F.size("vector").alias("length")).agg(F.count("*").alias("n"))
    sets = scratch.put(sets.withColumn("pid", F.monotonically_increasing_id().cast("string")))
    todo = classes.withColumn("length", F.size("vector")).join(sets, ["label", "length"])
    todo = todo.select("pid", F.lit(True).alias("inner"), F.lit(True).alias("own"), "node", "copies", "vector")
    parts, cores = _problems(scratch, todo, least)

    parts = parts.withColumn("chunk", F.explode(F.when(F.col("own"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("node", F.lit(2)), F.col("chunks")).cast("int")))))
    parts = parts.select("pid", "chunk", "own", "inner", "node", "copies", "vector").repartition(partitions(spark), "pid", "chunk")
    found = parts.sortWithinPartitions("pid", "chunk", F.desc("own")).mapInArrow(_solve(least), "node long, links long, low long")
    for core in cores:  # all nodes of a core link
        total = core.groupBy("pid").agg(F.sum("copies").alias("weight"), F.min("node").alias("low"))
        found = found.unionByName(core.join(total, "pid").select("node", (F.col("weight") - F.col("copies")).alias("links"), "low"))
    found = scratch.put(found)
    labels = components(spark, found.filter("node <> low").select(F.col("node").alias("u"), F.col("low").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    about = classes.select(*key, "node", "low_id", "copies").join(links, "node", "left").join(labels.withColumnRenamed("label", "reached"), "node", "left")
    about = scratch.put(about.select(*key, "low_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("reached", "node").alias("reached")))
    lows = about.groupBy("reached").agg(F.min("low_id").alias("component_id"))
    about = scratch.put(about.join(lows, "reached").select(*key, "n_links", "component_id"))
    out = each.select("vec_id", "sound", *key).join(about, key, "left")
    n_links = F.when(F.col("sound"), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long")
    component = F.when(F.col("sound"), F.coalesce("component_id", "vec_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", n_links.alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
