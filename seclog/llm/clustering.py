"""Centroid clustering of integer vectors with a vantage-point tree over the centroids.

Each round the driver builds a tree of the centroids and broadcasts it. A task takes its vectors in
blocks; every vector visits the open node with the least lower bound first, and nodes whose bound is
beyond its best distance are left out. Distances are exact integers, bounds err on the near side, and a
bound equal to the best distance is still visited, so the nearest centroid with the smallest number is
found as if all had been compared. A task sends one sum per cluster and component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from seclog.llm.common import schema_of, whole_row
from seclog.session import ship_code

CLUSTERS, ROUNDS, SCALE, COMPONENTS, SEED = 8, 10, 1024, 64, "3"
#: Values up to this size have squared distances of 64 components below 2^63, and exact sums in a block.
MOST_INT64 = 1 << 27
#: Bytes of a block's integers; a block also holds as many bounds as the tree has nodes.
BLOCK_BYTES = 8 << 20
#: Centroids of a leaf.
LEAF = 2
#: Sums travel in digits to this base, so that they are exact at any size.
LIMB = 32
_LONG_MAX = (1 << 63) - 1


@dataclass
class Node:
    """A vantage point with what lies inside and outside of it, or a leaf."""

    centroids: list[int]  # the vantage point, or a leaf's
    inside: int = -1
    outside: int = -1
    most_inside: int = 0  # squared distances from the vantage point
    least_outside: int = 0


@dataclass
class VantageTree:
    centroids: np.ndarray
    nodes: list[Node] = field(default_factory=list)

    def __post_init__(self):
        self._build(list(range(len(self.centroids))))

    def _build(self, members: list[int]) -> int:
        at = len(self.nodes)
        if len(members) <= LEAF:
            self.nodes.append(Node(members))
            return at
        far = [squared(self.centroids[members], self.centroids[m]) for m in members]
        # the point whose distances spread most tells its inside from its outside best
        chosen = max(range(len(members)), key=lambda n: (int(max(far[n])) - int(min(far[n])), -n))
        order = sorted((int(d), m) for d, m in zip(far[chosen], members) if m != members[chosen])
        half = (len(order) + 1) // 2
        node = Node([members[chosen]], most_inside=order[half - 1][0])
        self.nodes.append(node)
        node.inside = self._build([m for _, m in order[:half]])
        if order[half:]:
            node.least_outside = order[half][0]
            node.outside = self._build([m for _, m in order[half:]])
        return at


def squared(vectors: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers."""
    apart = vectors - point
    return (apart * apart).sum(axis=1)


def _low_root(x):
    """Not above the square root."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) for v in x], object)
    return np.sqrt(x.astype(np.float64)) * (1 - 1e-12)


def _high_root(x):
    """Not below the square root."""
    if x.dtype == object:
        return np.array([math.isqrt(int(v)) + 1 for v in x], object)
    return np.sqrt(x.astype(np.float64)) * (1 + 1e-12)


def nearest(tree: VantageTree, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of every vector's nearest centroid, the smallest number of equal ones.

    All vectors take one step at a time, each to its own best open node.
    """
    n, exact = len(vectors), vectors.dtype == object
    bounds = np.full((n, len(tree.nodes)), np.inf, object if exact else np.float64)
    bounds[:, 0] = 0
    best = np.full(n, -1, np.int64)
    distance = np.zeros(n, object if exact else np.int64)
    reach = np.full(n, np.inf, object if exact else np.float64)  # not below the root of the distance
    going = np.arange(n)
    while len(going):
        node_of = np.argmin(bounds[going], axis=1)
        ahead = bounds[going, node_of]
        more = (ahead <= reach[going]) & (ahead != np.inf)  # inclusive: an equal one may have a smaller number
        going, node_of = going[more], node_of[more]
        bounds[going, node_of] = np.inf
        for number in np.unique(node_of):
            node, rows = tree.nodes[number], going[node_of == number]
            for c in node.centroids:
                far = squared(vectors[rows], tree.centroids[c])
                better = (best[rows] < 0) | (far < distance[rows]) | ((far == distance[rows]) & (c < best[rows]))
                hit = rows[better]
                best[hit], distance[hit] = c, far[better]
                reach[hit] = _high_root(far[better])
            if node.inside >= 0:
                low, high = _low_root(far), _high_root(far)
                dtype = vectors.dtype
                bounds[rows, node.inside] = np.maximum(low - _high_root(np.array([node.most_inside], dtype))[0], 0)
                if node.outside >= 0:
                    bounds[rows, node.outside] = np.maximum(
                        _low_root(np.array([node.least_outside], dtype))[0] - high, 0)
    return best, distance


def quantised(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers where those are exact, else as Python's."""
    with np.errstate(over="ignore"):
        made = np.floor(values * float(scale))
    if not len(made) or np.abs(made).max() <= MOST_INT64:
        return made.astype(np.int64)
    whole = [int(x) * scale if abs(x) >= 2.0**52 else math.floor(x * scale) for x in values.ravel().tolist()]
    return np.array(whole, object).reshape(values.shape)


def _matched(centroids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with the kind of integers that holds both."""
    if centroids.dtype == object or vectors.dtype == object:
        return centroids.astype(object), vectors.astype(object)
    return centroids, vectors


def as_centroids(rows: list[list[int]]) -> np.ndarray:
    large = any(abs(x) > MOST_INT64 for row in rows for x in row)
    return np.array(rows, object if large else np.int64)


def _blocks(batch: pa.RecordBatch, components: int, scale: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of rows, and the integers of their vectors (the last column)."""
    step = max(1, BLOCK_BYTES // (8 * components))
    for start in range(0, batch.num_rows, step):
        part = batch.slice(start, step)
        flat = part.column(part.num_columns - 1).flatten().to_numpy(zero_copy_only=False)
        yield part, quantised(flat.astype(np.float64).reshape(-1, components), scale)


def _limbs(x: int) -> Iterator[tuple[int, int]]:
    sign, x, at = (-1 if x < 0 else 1), abs(x), 0
    while x:
        yield at, sign * (x & ((1 << LIMB) - 1))
        x, at = x >> LIMB, at + 1


def whole_vectors(vectors: DataFrame, column: str, components: int) -> DataFrame:
    """Rows whose array has exactly so many elements, none of them NULL, NaN or infinite."""
    x = F.col(f"`{column}`")
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.where((F.size(x) == components) & ~odd)


def first_centroids(
    vectors: DataFrame, id_column: str, column: str, clusters: int, scale: int, seed: str,
) -> list[list[int]]:
    """The vectors with the smallest hex SHA-256 of ``seed:id``; at most ``clusters`` rows come to the driver.

    Equal ids are in the order of their components, NULL ids come last.
    """
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(f"`{id_column}`").cast("string")), 256)
    chosen = vectors.select(name.alias("hash"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    rows = chosen.orderBy(F.asc_nulls_last("hash"), "v").limit(clusters).collect()
    return [quantised(np.array(r.v, np.float64), scale).tolist() for r in rows]


def cluster_sums(vectors: DataFrame, column: str, centroids: np.ndarray, scale: int) -> dict[tuple[int, int], int]:
    """One round over all vectors: exact sums by (cluster, component); component -1 counts, -2 adds distances.

    A task adds up its own vectors first; clusters times components rows come to the driver.
    """
    components = centroids.shape[1]
    ddl = "cluster int, component int, limb int, value long"
    fields = to_arrow_schema(schema_of(ddl))
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], int] = {}

        def add(c, component, value):
            total[c, component] = total.get((c, component), 0) + int(value)

        for batch in batches:
            for _, block in _blocks(batch, components, scale):
                own, block = _matched(tree.value.centroids, block)
                known = tree.value if own.dtype == tree.value.centroids.dtype else VantageTree(own)
                best, distance = nearest(known, block)
                for c in np.unique(best).tolist():
                    of_c = best == c
                    add(c, -1, of_c.sum())
                    add(c, -2, sum(distance[of_c].tolist()))
                    for k, value in enumerate(block[of_c].sum(axis=0).tolist()):
                        add(c, k, value)
        rows = [(c, k, limb, v) for (c, k), value in total.items() for limb, v in _limbs(value)]
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(zip(*rows), fields)], schema=fields)

    made = vectors.select(F.col(f"`{column}`").alias("v")).mapInArrow(run, ddl)
    sums = made.groupBy("cluster", "component", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[tuple[int, int], int] = {}
    for r in sums.collect():
        out[r.cluster, r.component] = out.get((r.cluster, r.component), 0) + (int(r.value) << (LIMB * r.limb))
    tree.unpersist()
    return out


def moved(centroids: np.ndarray, sums: dict[tuple[int, int], int]) -> np.ndarray:
    """Every centroid at the floor of its vectors' mean; one without vectors stays."""
    rows = centroids.tolist()
    for c in range(len(rows)):
        n = sums.get((c, -1), 0)
        if n:
            rows[c] = [sums.get((c, k), 0) // n for k in range(len(rows[c]))]
    return as_centroids(rows)


def fit(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS,
    rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS, seed: str = SEED,
) -> np.ndarray:
    """Centroids after ``rounds`` rounds; fewer run only if a round moved nothing, as later ones would neither.

    With fewer vectors than clusters every vector starts one; without vectors there are none.
    """
    ship_code(vectors.sparkSession)
    kept = whole_vectors(vectors, column, components)
    centroids = as_centroids(first_centroids(kept, id_column, column, clusters, scale, seed))
    for _ in range(rounds if len(centroids) else 0):
        new = moved(centroids, cluster_sums(kept, column, centroids, scale))
        if np.array_equal(new, centroids):
            break
        centroids = new
    return centroids


ASSIGNED = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def assign(
    vectors: DataFrame, centroids: np.ndarray, column: str = "embedding", scale: int = SCALE,
    components: int = COMPONENTS, keep: list[str] | None = None,
) -> DataFrame:
    """``row`` (the ``keep`` columns) of every vector with its ``cluster, distance, cluster_inertia, inertia,
    centroid_sha256``.

    Vectors of another length and those with NULL, NaN or infinite components have no row; repeated rows
    each have one. A distance or sum beyond 64 bits is NULL. Without centroids there are no rows.
    """
    ship_code(vectors.sparkSession)
    kept = whole_vectors(vectors, column, components)
    chosen = kept if keep is None else kept.select(*[f"`{c}`" for c in keep])
    given = kept.select(whole_row(chosen).alias("row"), F.col(f"`{column}`").alias("v"))
    out = StructType().add("row", given.schema["row"].dataType)
    for f in schema_of(ASSIGNED):
        out.add(f)
    fields = to_arrow_schema(out)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], out)
    sums = cluster_sums(kept, column, centroids, scale)
    inertia = {c: sums.get((c, -2), 0) for c in range(len(centroids))}
    long = lambda x: x if x <= _LONG_MAX else None
    of_cluster, of_all = [long(inertia[c]) for c in range(len(centroids))], long(sum(inertia.values()))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    tree = vectors.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in _blocks(batch, components, scale):
                own, block = _matched(tree.value.centroids, block)
                known = tree.value if own.dtype == tree.value.centroids.dtype else VantageTree(own)
                best, distance = nearest(known, block)
                number = pa.array(best.astype(np.int32))
                columns = [
                    number, pa.array([long(d) for d in distance.tolist()], pa.int64()),
                    pa.array(of_cluster, pa.int64()).take(number), pa.array([of_all] * len(best), pa.int64()),
                    pa.array(names, fields.field("centroid_sha256").type).take(number),
                ]
                row = part.column(0).cast(fields.field(0).type)
                yield pa.RecordBatch.from_arrays([row, *columns], schema=fields)

    return given.mapInArrow(run, out)


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", keep: list[str] | None = None,
    clusters: int = CLUSTERS, rounds: int = ROUNDS, scale: int = SCALE, components: int = COMPONENTS,
    seed: str = SEED,
) -> DataFrame:
    """Every whole vector with the cluster it ends in: see ``fit`` and ``assign``."""
    centroids = fit(vectors, id_column, column, clusters, rounds, scale, components, seed)
    return assign(vectors, centroids, column, scale, components, keep)
