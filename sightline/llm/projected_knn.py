"""Nearest neighbours by low-dimensional stable projections under a kd-tree, with a chi-square stopping test.

A vector is projected to DIMENSIONS Gaussian (2-stable) directions, so the squared projected distance over the squared distance is chi-square
with DIMENSIONS degrees of freedom. The projected space is cut into cells by a kd-tree fitted to a bounded sample; each cell's vectors get a kd-tree of their own. A query first searches its
home cell for an upper bound on the distance of its k-th neighbour, and then every cell whose projected distance passes the test
below that bound. Within a cell leaves come in order of projected distance, and their points that the test does not rule out are verified on the original vectors,
until the next leaf's squared distance is over the chi-square quantile times the k-th squared distance found.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm import common

DIMENSIONS = 16
#: Chance with which a true neighbour passes the test.
CONFIDENCE = 0.975
#: Vectors a cell, or a block of one that came out larger; most sampled vectors for the cells; vectors a leaf; queries sent to one copy of a block.
CELL = 16_384
SAMPLE = 50_000
LEAF = 64
QUERIES = 16_384


def chi_square_quantile(p: float, even: int) -> float:
    """The quantile for an even number of degrees of freedom, whose distribution function is a finite sum."""
    low, high = 0.0, 1e4
    for _ in range(200):
        x = (low + high) / 2
        term = total = math.exp(-x / 2)
        for i in range(1, even // 2):
            term *= x / 2 / i
            total += term
        low, high = (x, high) if 1 - total < p else (low, x)
    return high


def directions(width: int, dimensions: int = DIMENSIONS, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dimensions))


def split(points: np.ndarray, size: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A kd-tree by medians of the widest side: inner nodes (side, cut, left, right), children below zero being leaves -1 - i, and
    the rows of each leaf of at most size points (more only where all are equal)."""
    nodes: list[list[float]] = []
    leaves: list[np.ndarray] = []

    def grow(rows: np.ndarray) -> int:
        if len(rows) > size:
            part = points[rows]
            side = int(np.argmax(part.max(0) - part.min(0)))
            cut = float(np.median(part[:, side]))
            left = part[:, side] < cut
            if not left.any():
                left = part[:, side] <= cut
            if left.any() and not left.all():
                me = len(nodes)
                nodes.append([side, float((part[left, side].max() + part[~left, side].min()) / 2), 0, 0])
                nodes[me][2], nodes[me][3] = grow(rows[left]), grow(rows[~left])
                return me
        leaves.append(rows)
        return -len(leaves)

    root = grow(np.arange(len(points)))
    return np.array([[root, 0, 0, 0], *nodes], float), leaves


def cell_of(tree: np.ndarray, points: np.ndarray) -> np.ndarray:
    at = np.full(len(points), int(tree[0, 0]))
    while (inner := np.flatnonzero(at >= 0)).size:
        node = tree[1 + at[inner]]
        right = points[inner, node[:, 0].astype(int)] >= node[:, 1]
        at[inner] = np.where(right, node[:, 3], node[:, 2]).astype(int)
    return -1 - at


def cell_distances(tree: np.ndarray, point: np.ndarray) -> list[tuple[int, float]]:
    """Each cell and the squared projected distance of a point to it, cells being half-open boxes between cuts."""
    out, stack = [], [(int(tree[0, 0]), np.zeros(len(point)))]
    while stack:
        at, gap = stack.pop()
        if at < 0:
            out.append((-1 - at, float((gap * gap).sum())))
            continue
        side, cut, left, right = tree[1 + at]
        side = int(side)
        for child, off in ((left, point[side] - cut), (right, cut - point[side])):
            further = gap.copy()
            further[side] = max(gap[side], off, 0.0)
            stack.append((int(child), further))
    return out


class Cell:
    """The vectors of a cell, their smallest ids, and a kd-tree over their projections."""

    def __init__(self, vectors: np.ndarray, ids: list[list[int]], projected: np.ndarray) -> None:
        _, leaves = split(projected, LEAF)
        order = np.concatenate(leaves) if leaves else np.zeros(0, int)
        self.vectors, self.ids, self.projected = vectors[order], [ids[i] for i in order], projected[order]
        self.single = np.array([i[0] if len(i) == 1 else -1 for i in self.ids])
        self.is_single = np.array([len(i) == 1 for i in self.ids], bool)
        self.bounds = np.cumsum([0, *map(len, leaves)])
        pairs = list(zip(self.bounds[:-1], self.bounds[1:], strict=True))
        self.low = np.array([self.projected[a:b].min(0) for a, b in pairs])
        self.high = np.array([self.projected[a:b].max(0) for a, b in pairs])
        self.verified = 0

    def search(self, query: np.ndarray, point: np.ndarray, k: int, quantile: float, bound: float = math.inf, own: int | None = None) -> list[tuple[float, int]]:
        """The k nearest (distance, id) found, with ties by id; bound is a known upper bound of the k-th squared distance, own an id that is no candidate.
        Leaves come in order of projected distance until the test holds for the next; of a leaf, points for which it holds are passed over."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0.0)
        far = (gap * gap).sum(1)
        best: list[tuple[float, int]] = []
        order = np.argsort(far, kind="stable")
        at = 0
        while at < len(order) and far[order[at]] <= quantile * bound * (1 + 1e-9):
            some = order[at : at + 8]  # a few leaves at once
            at += len(some)
            some = some[far[some] <= quantile * bound * (1 + 1e-9)]
            rows = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1]) for i in some])
            if own is not None:
                rows = rows[~(self.is_single[rows] & (self.single[rows] == own))]
            if bound < math.inf:
                away = self.projected[rows] - point
                rows = rows[(away * away).sum(1) <= quantile * bound * (1 + 1e-9)]
            self.verified += len(rows)
            diff = self.vectors[rows] - query
            squares = (diff * diff).sum(1)
            if len(best) >= k:
                rows, squares = rows[squares <= best[-1][0] ** 2 * (1 + 1e-9)], squares[squares <= best[-1][0] ** 2 * (1 + 1e-9)]
            near = np.argsort(squares, kind="stable")
            if len(near) > k:  # with all ties of the k-th
                near = near[squares[near] <= squares[near[k - 1]]]
            best = sorted([*best, *((math.sqrt(squares[i]), v) for i in near for v in self.ids[rows[i]] if v != own)])[:k]
            if len(best) == k:
                bound = min(bound, best[-1][0] ** 2)
        return best


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, and all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _search(project: np.ndarray, k: int, quantile: float):
    """Streams rows (cell, block, part, kind, ask, own, bound, v, ids) in this order: the vectors of a block first, then the queries that visit it."""

    def stream(batches):
        import pyarrow as pa

        now, vectors, ids, cell = None, [], [], None
        width = len(project)
        for batch in batches:
            keys = zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True)
            asks, owns, limits, v = (batch.column(i) for i in range(4, 8))
            listed = batch.column(8)
            out = {"ask": [], "scores": [], "ids": [], "verified": []}
            for row, (*key, kind) in enumerate(keys):
                if key != now:
                    now, vectors, ids, cell = key, [], [], None
                if kind == 0:
                    vectors.append(v[row].as_py())
                    ids.append(listed[row].as_py())
                    continue
                if cell is None and vectors:
                    points = np.frombuffer(b"".join(vectors)).reshape(-1, width)
                    cell, vectors = Cell(points, ids, points @ project), []
                if cell is None:
                    continue
                q, limit, before = np.frombuffer(v[row].as_py()), limits[row].as_py(), cell.verified
                best = cell.search(q, q @ project, k + 1, quantile, math.inf if limit is None else limit, owns[row].as_py())
                out["ask"].append(asks[row].as_py())
                out["scores"].append([s for s, _ in best])
                out["ids"].append([i for _, i in best])
                out["verified"].append(cell.verified - before)
            yield pa.RecordBatch.from_arrays([pa.array(out["ask"], pa.int64()), pa.array(out["scores"], pa.list_(pa.float64())), pa.array(out["ids"], pa.list_(pa.int64())), pa.array(out["verified"], pa.int64())], names=list(out))

    return stream


def _packed(df: DataFrame, names: list[str]) -> DataFrame:
    """df with the vector v as the bytes of its doubles, which are shipped and compared faster than arrays."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index("v")
            v = batch.column(at)
            flat, ends = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), float), np.asarray(v.offsets)
            ends = ends - ends[0]
            columns = [pa.array([flat[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.select(*names).mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'v' else kinds[n]}" for n in names))


def _found(nodes: DataFrame, asked: DataFrame, width: int, k: int, confidence: float) -> DataFrame:
    """ask, scores, ids, verified of each visit of a query to a block: nodes(node, v, ids) and asked(ask, v, own), v the bytes of width doubles."""
    import pyarrow as pa

    project = directions(width)
    quantile = chi_square_quantile(confidence, DIMENSIONS)
    n = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("v").collect() if n > CELL else []
    sampled = np.frombuffer(b"".join(r["v"] for r in sample)).reshape(-1, width) @ project
    tree = split(sampled, max(16, len(sampled) * CELL // n))[0] if len(sampled) else np.array([[-1.0, 0, 0, 0]])

    def place(batches):
        for batch in batches:
            v = np.frombuffer(b"".join(batch.column(1).to_pylist())).reshape(-1, width)
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(tree, v @ project).astype(np.int32)), *batch.columns], names=["cell", *batch.schema.names])

    data = common.materialise(nodes.select("node", "v", "ids").mapInArrow(place, "cell int, node long, v binary, ids array<long>"), "cells")
    homes = common.materialise(asked.select("ask", "v", "own").mapInArrow(place, "cell int, ask long, v binary, own long"), "homes")
    held = data.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("blocks"))  # at most SAMPLE / 16 cells

    def visit(asking: DataFrame) -> DataFrame:
        """asking(cell, ask, v, own, bound) against the vectors of the cells. A cell's vectors are copied as its own queries need."""
        asking = common.materialise(asking, "visits")
        counts = asking.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))
        plan = F.broadcast(common.materialise(held.join(counts, "cell"), "visit-plan"))
        none = lambda kind: F.lit(None).cast(kind)
        block, part = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("ask", F.lit(1)), F.col("parts")).cast("int")
        left = asking.join(plan, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.alias("part"), F.lit(1).alias("kind"), "ask", "own", "bound", "v", none("array<long>").alias("ids"))
        right = data.join(plan, "cell").select("cell", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), none("long").alias("ask"), none("long").alias("own"), none("double").alias("bound"), "v", "ids")
        stream = left.unionByName(right).repartition("cell", "block", "part").sortWithinPartitions("cell", "block", "part", "kind")
        return common.materialise(stream.mapInArrow(_search(project, k, quantile), "ask long, scores array<double>, ids array<long>, verified long"), "found")

    first = visit(homes.withColumn("bound", F.lit(None).cast("double")))
    if len(tree) == 1:
        return first
    bound = F.when(F.size("scores") > k, F.pow(F.element_at("scores", -1), 2))
    known = homes.join(first.groupBy("ask").agg(F.min(bound).alias("bound")), "ask", "left").select("cell", "ask", "v", "own", "bound")

    def route(batches):
        for batch in batches:
            rows, cells = [], []
            limits = batch.column(4).to_pylist()
            points = np.frombuffer(b"".join(batch.column(2).to_pylist())).reshape(-1, width) @ project
            for row, (home, limit) in enumerate(zip(batch.column(0).to_pylist(), limits, strict=True)):
                near = [cell for cell, far in cell_distances(tree, points[row]) if cell != home and (limit is None or far <= quantile * limit * (1 + 1e-9))]
                cells += near
                rows += [row] * len(near)
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(batch.column(i).take(pa.array(rows)) for i in range(1, 5))], names=batch.schema.names)
                    rows, cells = [], []
            yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), *(batch.column(i).take(pa.array(rows, pa.int64())) for i in range(1, 5))], names=batch.schema.names)

    return first.unionByName(visit(known.mapInArrow(route, "cell int, ask long, v binary, own long, bound double")))


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance in double precision) of the k nearest found of each row that the queries condition holds for.

    Candidates are all rows but the query's own id, of its vector's width. Rows whose vector is null, empty, zero or has a null or non-finite component, or
    whose id is null, take no part; a query among them has no rows. Equal vectors are one node with its k + 1 smallest distinct ids, which hold every answer;
    ties go to the smaller id. Repeated ids are one candidate each if their vectors differ, and none for a query of that id. With too few candidates all
    are returned; an empty table gives no rows; other columns are ignored. A true neighbour is missed with chance 1 - confidence at most.
    """
    spark = vectors.sparkSession
    rows = vectors.where(usable(vectors[vector]) & vectors[key].isNotNull()).select(vectors[key].cast("long").alias("id"), F.transform(vectors[vector], lambda x: x.cast("double") + F.lit(0.0)).alias("v"), queries.alias("is_query"))
    rows = common.materialise(_packed(rows.withColumn("width", F.size("v")), ["id", "v", "width", "is_query"]), "vectors")
    by_vector = Window.partitionBy("v").orderBy("id")
    small = rows.select("v", "width", "id").distinct().withColumn("n", F.row_number().over(by_vector)).where(F.col("n") <= k + 1)
    nodes = small.groupBy("v", "width").agg(F.sort_array(F.collect_set("id")).alias("ids"))
    nodes = common.materialise(nodes.select(F.col("ids")[0].alias("node"), "v", "ids", "width"), "nodes")
    # an id of one row takes one of k + 1 places; one of several rows is left out by name
    several = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id", F.col("id").alias("own"))
    who = rows.where("is_query").select("id", "v", "width").distinct().join(several, "id", "left")
    who = common.materialise(who.select(F.col("id").alias("query_id"), "v", "width", "own"), "queries")
    asked = common.materialise(who.select("v", "width", "own").distinct().select(F.monotonically_increasing_id().alias("ask"), "v", "width", "own"), "asked")
    widths = [r["width"] for r in asked.select("width").distinct().orderBy("width").collect()]
    if not widths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    results = None
    for w in widths:
        some = _found(nodes.where(F.col("width") == w), asked.where(F.col("width") == w), w, k, confidence)
        results = some if results is None else results.unionByName(some)
    flat = results.select("ask", F.explode(F.arrays_zip("scores", "ids")).alias("x")).select("ask", F.col("x.scores").alias("score"), F.col("x.ids").alias("vec_id"))
    of_ask = Window.partitionBy("ask").orderBy("score", "vec_id")
    best = flat.withColumn("n", F.row_number().over(of_ask)).where(F.col("n") <= k + 1).groupBy("ask").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("best"))
    by = asked.select("ask", F.col("v").alias("w"), F.col("own").alias("o"))
    who = who.join(by, (F.col("v") == F.col("w")) & F.col("own").eqNullSafe(F.col("o"))).select("query_id", "ask")
    others = F.filter("best", lambda x: x["vec_id"] != F.col("query_id"))
    out = who.join(best, "ask").select("query_id", F.posexplode(F.slice(others, 1, k)).alias("p", "x"))
    return out.select("query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))
