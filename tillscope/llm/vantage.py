"""Centroid clustering: exact k-means on integers, searched through a vantage-point tree.

The centroids of a round, k of a fixed number, form a vantage-point tree: each
node has a vantage point and halves the others by their distance to it, a leaf
holds a few. The tree is broadcast, and every vector searches it best-first:
it opens the open node with the smallest lower bound until no bound is within
the distance found so far. Bounds come from the triangle inequality in floating
point, with a margin; the radius is inclusive, so that a centroid at the same
distance but with a smaller number is still found. Distances are exact integers.
Sums by centroid are made in each task first and leave it as digits of base
2^30, which Spark adds: exact for any size of numbers.

Cases: a vector that has not exactly ``DIMENSIONS`` components, or a null or non-finite one, is left out; so is a null
vector. A null vec_id counts as empty text in the order of the start and stays
null. Repeated rows each count. With fewer vectors than centroids each is a
start; an empty table gives an empty result. A distance or sum too large for a long
is null, though it is compared exactly. Other columns are not read.
"""

import hashlib
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.functions.staging import stage
from tillscope.llm.common import ship

DIMENSIONS, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
#: Most numbers (centroids times dimensions) of a tree; more would not be broadcast.
LARGEST = 1 << 24
LEAF = 4
#: Integers below this give squared distances that fit 64 bits, for up to 64 components.
SMALL = 1 << 27
MARGIN = 1e-9
_DIGIT = 30


def quantised(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit integers where all are small, else Python's."""
    with np.errstate(over="ignore"):
        scaled = np.floor(SCALE * x)
    if not x.size or np.abs(scaled).max() < SMALL:
        return scaled.astype(np.int64)
    whole = [math.floor(v * SCALE) if abs(v) < 2.0 ** 52 else int(v) * SCALE for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(x.shape)


class VantageTree:
    """A vantage-point tree over the rows of an integer array."""

    def __init__(self, points: np.ndarray):
        self.points, self.nodes = points, []
        self.exact = points.dtype == object or points.shape[1] > 64
        if len(points):
            self._grow(np.arange(len(points)))

    def _grow(self, own: np.ndarray) -> int:
        """Add the node of ``own``: (its candidates, [(child, least, greatest distance to the vantage point)])."""
        at = len(self.nodes)
        self.nodes.append(None)
        if len(own) <= LEAF or self.exact:
            self.nodes[at] = (own, [])
            return at
        middle = self.points[own].mean(0)
        first = int(np.argmax(((self.points[own] - middle) ** 2).sum(1)))  # far out, so that distances differ
        vantage, rest = own[first], np.delete(own, first)
        d = np.sqrt(((self.points[rest] - self.points[vantage]) ** 2).sum(1).astype(np.float64))
        order = np.argsort(d, kind="stable")
        half = len(rest) // 2
        kids = [(self._grow(np.sort(rest[part])), float(d[part[0]]), float(d[part[-1]])) for part in (order[:half], order[half:]) if len(part)]
        self.nodes[at] = (np.array([vantage]), kids)
        return at

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Squared distances of the rows of x to the chosen points: a row each."""
        out = [((x - p) ** 2).sum(1) for p in self.points[which]]
        return np.stack(out, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest point to each row of x, the smaller number where distances tie."""
        exact = self.exact or x.dtype == object
        if exact:  # one node with all points: numbers of any size
            which = np.arange(len(self.points))
            d = self.distances(x.astype(object), which)
            best = np.array([min(range(len(which)), key=row.__getitem__) for row in d], np.int64)
            return best, np.array([row[b] for row, b in zip(d, best)], object)
        none = np.iinfo(np.int64).max
        best, near = np.full(len(x), len(self.points)), np.full(len(x), none)
        bound = np.full((len(x), len(self.nodes)), np.inf)
        bound[:, 0] = 0
        rows = np.arange(len(x))
        while len(rows):
            node = bound[rows].argmin(1)
            low = bound[rows, node]
            radius = np.where(near[rows] == none, np.inf, np.sqrt(near[rows].astype(np.float64)) * (1 + MARGIN))
            go = np.isfinite(low) & (low <= radius)
            rows, node, low = rows[go], node[go], low[go]
            bound[rows, node] = np.inf
            for m in np.unique(node).tolist():
                which, kids = self.nodes[m]
                here = node == m
                own = rows[here]
                d = self.distances(x[own], which)
                for j, c in enumerate(which.tolist()):
                    better = (d[:, j] < near[own]) | ((d[:, j] == near[own]) & (c < best[own]))
                    near[own], best[own] = np.where(better, d[:, j], near[own]), np.where(better, c, best[own])
                if kids:
                    away = np.sqrt(d[:, 0].astype(np.float64))
                    slack = MARGIN * away
                    for kid, least, most in kids:
                        bound[own, kid] = np.maximum(low[here], np.maximum(away - most - slack, least * (1 - MARGIN) - away))
        return best, near


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    """The vectors of a batch as integers, a row each."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return quantised(flat.reshape(batch.num_rows, -1))


def _blocks(batches: Iterator[pa.RecordBatch], tree: VantageTree) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that the bounds of all nodes fit in memory."""
    most = max(1, (1 << 22) // max(1, len(tree.nodes)))
    for batch in batches:
        for at in range(0, batch.num_rows, min(most, 4096)):
            part = batch.slice(at, min(most, 4096))
            yield part, _rows(part)


def _sums(vectors: DataFrame, packed) -> dict[int, tuple[int, list[int]]]:
    """{centroid: (vectors nearest to it, their exact sums)}; k times the dimensions numbers come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(packed.value)
        count, total = {}, {}
        for _, x in _blocks(batches, tree):
            best, _ = tree.nearest(x)
            for c in np.unique(best).tolist():
                own = x[best == c]
                s = own.sum(0)
                count[c] = count.get(c, 0) + len(own)
                total[c] = [a + b for a, b in zip(total.get(c, [0] * len(s)), s.tolist())]
        out = []
        for c, s in total.items():
            for j, v in enumerate([count[c], *s]):
                sign, v, place = (-1 if v < 0 else 1), abs(v), 0
                while v:
                    out.append((c, j, place, sign * (v & ((1 << _DIGIT) - 1))))
                    v, place = v >> _DIGIT, place + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(col, pa.int64()) for col in zip(*out)], ["c", "j", "place", "digit"])

    parts = vectors.mapInArrow(add, "c long, j long, place long, digit long").groupBy("c", "j", "place").agg(F.sum("digit").alias("digit"))
    found: dict[int, dict[int, int]] = {}
    for r in parts.collect():
        own = found.setdefault(r["c"], {})
        own[r["j"]] = own.get(r["j"], 0) + (r["digit"] << (_DIGIT * r["place"]))
    return {c: (own.pop(0), own) for c, own in found.items()}


def _integers(rows: list) -> np.ndarray:
    small = all(abs(v) < SMALL for row in rows for v in row)
    return np.array(rows, dtype=np.int64 if small else object)


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, dimensions: int = DIMENSIONS) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of each vector kept, final centroids). ``vectors``: vec_id, embedding."""
    spark = vectors.sparkSession
    ship(spark)
    if centroids * dimensions > LARGEST:
        raise ValueError(f"{centroids} centroids of {dimensions} components are more than {LARGEST} numbers")
    v = F.col("embedding").cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    kept = vectors.select("vec_id", v.alias("v")).where((F.size("v") == dimensions) & F.forall("v", finite))
    kept = stage(kept, "vectors")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = kept.orderBy(name, "v").select("v").limit(centroids).collect()
    points = quantised(np.array([r["v"] for r in start], np.float64).reshape(-1, dimensions))
    pack = lambda: spark.sparkContext.broadcast(pickle.dumps(VantageTree(points)))
    for _ in range(rounds if len(points) else 0):
        packed = pack()
        rows = points.tolist()
        for c, (n, s) in _sums(kept, packed).items():
            rows[c] = [s.get(j + 1, 0) // n for j in range(dimensions)]
        points = _integers(rows)
        packed.unpersist()
    packed = pack()

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = pickle.loads(packed.value)
        for part, x in _blocks(batches, tree):
            best, d = tree.nearest(x)
            fits = [int(v) if v < 1 << 63 else None for v in d] if d.dtype == object else d
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best, pa.int32()), pa.array(fits, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = kept.schema["vec_id"].dataType.simpleString()
    return kept.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"), points


def op11_vantage_tree(spark: SparkSession, folder: str) -> DataFrame:
    found, points = cluster(spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding"))
    found = stage(found, "clusters")
    total = F.when(F.count("*") == F.count("distance"), F.sum(F.col("distance").cast("decimal(38,0)"))).alias("total")
    own = {r["cluster"]: r["total"] for r in found.groupBy("cluster").agg(total).collect()}  # at most one row for each centroid
    fits = lambda v: int(v) if v is not None and v < 1 << 63 else None
    every = fits(None if None in own.values() else sum(own.values()))
    name = lambda c: hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest()
    told = spark.createDataFrame([(c, fits(v), every, name(c)) for c, v in sorted(own.items())], "_c int, cluster_inertia long, inertia long, centroid_sha256 string")
    out = found.join(F.broadcast(told), F.col("cluster") == F.col("_c"))
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    steps = [f"""p as materialized (
  select row_number() over () as i, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::double)::bigint) as v, embedding from embeddings
  where len(embedding) = {DIMENSIONS} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), c0 as materialized (
  select (row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, '')), embedding) - 1)::hugeint as c, v from p
  qualify row_number() over (order by sha256('{SEED}:' || coalesce(vec_id::varchar, '')), embedding) <= {CENTROIDS}
)"""]
    for r in range(ROUNDS + 1):
        steps.append(f"""a{r} as materialized (
  select i, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::hugeint * {CENTROIDS} + c.c) as m from p, c{r} c group by i
)""")
        if r < ROUNDS:
            steps.append(f"""c{r + 1} as materialized (
  with s as (select m % {CENTROIDS} as c, j, sum(p.v[j])::hugeint as s, count(*)::hugeint as n from a{r} join p using (i), range(1, {DIMENSIONS + 1}) t(j) group by 1, 2),
  f as (select c, list(((s - ((s % n) + n) % n) // n)::bigint order by j) as v from s group by c)
  select o.c, coalesce(f.v, o.v) as v from c{r} o left join f using (c)
)""")
    return f"""with {', '.join(steps)}, d as (
  select i, (m % {CENTROIDS})::int as cluster, (m // {CENTROIDS})::bigint as distance from a{ROUNDS}
)
select vec_id, cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia, (sum(distance) over ())::bigint as inertia,
  sha256(array_to_string(k.v, ',')) as centroid_sha256
from d join p using (i) join c{ROUNDS} k on k.c = d.cluster
"""


OP11_SQL = _sql()
