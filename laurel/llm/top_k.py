"""Exact top-k inner-product search with ball trees.

Vectors are turned into integers floor(scale * x), so scores are exact.

1. Equal vectors collapse: of one vector only the k + 1 smallest ids can be among anyone's
   k best, as ties go to smaller ids and a query leaves out itself.
2. The top of one tree is split on at most `sample` vectors chosen by a hash; its leaves are at
   most `most_leaves`. The vectors nearest to a leaf are cut by a hash into shards of about
   `shard_rows`, and every shard builds a ball tree over its own vectors.
3. Each query first searches a home shard. The k-th score found there is shared: a query
   visits the shards of a leaf only if the leaf's ball can reach that score.
4. In a shard nodes are taken in the order of their bound, center . q + radius * |q|, until
   the bound falls below the current k-th score, which starts at the shared one.
5. The best of all visited shards are ranked once more.

Vectors of different lengths have no inner product; each length is searched on its own. Scores are
computed in doubles where those are exact, else in 64-bit or in unbounded integers. A component or a
score beyond 64 bits is an error, not a missing row.

Defined results: vectors that are null, empty or hold null or non-finite components take no part,
nor do rows with a null id. Candidates with the query's own id are left out. A query with fewer
than k other rows gets all of them.
"""

from __future__ import annotations

import dataclasses
import heapq
import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed

LEAF = 64
EXACT = 1 << 53  # doubles hold all whole numbers up to here


def scaled(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component; null unless all are finite. Beyond 62 bits it fails."""
    size = lambda x: F.abs(x.cast("double") * scale)
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    large = F.exists(vector, lambda x: size(x) >= 2.0 ** 62)
    failed = F.raise_error(F.lit("a scaled component has more than 62 bits")).cast("array<bigint>")
    return F.when((F.size(vector) > 0) & finite, F.when(large, failed).otherwise(whole))


@dataclasses.dataclass(frozen=True)
class BallTree:
    """Nodes in arrays; children of node i are at child[i] and child[i] + 1, 0 for leaves."""

    vectors: np.ndarray  # in leaf order
    order: np.ndarray  # original places
    center: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray

    @staticmethod
    def build(vectors: np.ndarray, leaf: int = LEAF) -> BallTree:
        order = np.arange(len(vectors))
        center, radius, first, last, child = [], [], [], [], []

        def add(a: int, b: int) -> None:
            own = vectors[order[a:b]]
            middle = own.mean(axis=0)
            center.append(middle)
            radius.append(np.sqrt(((own - middle) ** 2).sum(axis=1).max()))
            first.append(a)
            last.append(b)
            child.append(0)

        add(0, len(vectors))
        node = 0
        while node < len(first):
            a, b = first[node], last[node]
            own = vectors[order[a:b]]
            if b - a > leaf and radius[node] > 0:
                far = own[((own - center[node]) ** 2).sum(axis=1).argmax()]
                other = own[((own - far) ** 2).sum(axis=1).argmax()]
                along = np.argsort(own @ (other - far), kind="stable")
                order[a:b] = order[a:b][along]
                child[node] = len(first)
                add(a, (a + b) // 2)
                add((a + b) // 2, b)
            node += 1
        return BallTree(vectors[order], order, np.array(center), np.array(radius), np.array(first),
                        np.array(last), np.array(child))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """No inner product in a node exceeds its bound (queries x nodes)."""
        lengths = np.sqrt((queries * queries).sum(axis=1))
        reach = queries @ self.center.T + lengths[:, None] * self.radius
        return reach + 1e-9 * (1 + np.abs(reach) + lengths[:, None] * np.sqrt(
            (self.center ** 2).sum(axis=1)))

    def pack(self, whole: np.ndarray, ids: np.ndarray) -> bytes:
        """The tree with the whole-number vectors it was built from, and their ids."""
        out = io.BytesIO()
        rest = {f.name: getattr(self, f.name) for f in dataclasses.fields(self) if f.name != "vectors"}
        np.savez(out, whole=whole[self.order], ids=ids[self.order], **rest)
        return out.getvalue()

    @staticmethod
    def unpack(blob: bytes) -> tuple[BallTree, np.ndarray, np.ndarray]:
        with np.load(io.BytesIO(blob)) as parts:
            rest = {f.name: parts[f.name] for f in dataclasses.fields(BallTree) if f.name != "vectors"}
            whole = parts["whole"]
            return BallTree(vectors=whole.astype(np.float64), **rest), whole, parts["ids"]


class Shard:
    """A ball tree over distinct vectors, each with the smallest ids that hold it."""

    def __init__(self, blob: bytes):
        self.tree, self.whole, self.ids = BallTree.unpack(blob)  # ids: vectors x (k + 1), MISSING where fewer
        self.largest = int(np.abs(self.whole).max(initial=0))

    def scores(self, a: int, b: int, query: np.ndarray, largest: int) -> np.ndarray:
        """Exact inner products with the vectors from a to b; `largest` is the query's."""
        bound = self.largest * largest * self.whole.shape[1]
        if max(bound, self.largest, largest) < EXACT:
            return (self.tree.vectors[a:b] @ query.astype(np.float64)).astype(np.int64)
        if bound < 1 << 63:
            return self.whole[a:b] @ query
        return self.whole[a:b].astype(object) @ query.astype(object)

    def search(self, own: np.ndarray, queries: np.ndarray, known: np.ndarray,
               k: int) -> Iterator[tuple[int, int, int]]:
        """(query, id, score) of the k best in this shard that can be among the k best of all."""
        tree = self.tree
        for at in range(0, len(own), 1024):
            some = queries[at:at + 1024]
            largest = np.abs(some).max(axis=1).tolist()
            for q, vector, size, least, bound in zip(
                    own[at:at + 1024].tolist(), some, largest, known[at:at + 1024].tolist(),
                    tree.bounds(some.astype(np.float64))):
                best: list[tuple[int, int]] = []  # heap of (score, -id), the worst first
                nodes = [(-bound[0], 0)]
                while nodes:
                    top, node = heapq.heappop(nodes)
                    worst = max(least, best[0][0] if len(best) == k else least)
                    if -top < worst:
                        break
                    if tree.child[node]:
                        for c in (tree.child[node], tree.child[node] + 1):
                            if bound[c] >= worst:
                                heapq.heappush(nodes, (-bound[c], int(c)))
                        continue
                    a, b = tree.first[node], tree.last[node]
                    scores = self.scores(a, b, vector, size)
                    for place in np.flatnonzero(scores >= worst).tolist():
                        for other in self.ids[a + place].tolist():
                            if other == q or other < 0 and other == MISSING:
                                continue
                            entry = (int(scores[place]), -other)
                            if len(best) < k:
                                heapq.heappush(best, entry)
                            elif entry > best[0]:
                                heapq.heapreplace(best, entry)
                for score, other in best:
                    yield q, -other, score


MISSING = -(1 << 63)


def _top_tree(rows: np.ndarray, shards: int) -> BallTree:
    return BallTree.build(rows, max(1, -(-len(rows) // shards)))


def _leaves(tree: BallTree) -> np.ndarray:
    return np.flatnonzero(tree.child == 0)


def _whole(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.int64).reshape(len(column), -1)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def _known(column: pa.Array) -> np.ndarray:
    """Known k-th scores, never above the exact ones; minus infinity where there is none."""
    values = column.fill_null(0).to_numpy(zero_copy_only=False)
    floats = values.astype(np.float64)
    floats = np.where(np.abs(floats) >= EXACT, np.nextafter(floats, -np.inf), floats)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), -np.inf, floats)


def top_k_search(rows: DataFrame, is_query: Column, k: int = 5, scale: int = 256,
                 id_col: str = "vec_id", vector_col: str = "embedding", **options) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k highest scores of every row where `is_query`."""
    own = rows.select(F.col(id_col).cast("long").alias("id"), scaled(vector_col, scale).alias("vector"),
                      F.coalesce(is_query, F.lit(False)).alias("asks"))
    own = checkpointed(own.where(F.col("id").isNotNull() & F.col("vector").isNotNull()).distinct())
    found = rows.sparkSession.createDataFrame([], "query_id long, vec_id long, score long")
    for r in own.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():
        found = found.unionByName(_search_length(own.where(F.size("vector") == r["n"]), k, **options))
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _search_length(own: DataFrame, k: int, shard_rows: int = 16_384, most_leaves: int = 4096,
                   sample: int = 20_000, query_rows: int = 8192) -> DataFrame:
    """(query_id, vec_id, score) of rows (id, vector, asks) with vectors of one length: at least the
    k best of every query."""
    spark = own.sparkSession
    # Distinct vectors with their k + 1 smallest ids: the partial top keeps a hot vector small.
    by_vector = W.partitionBy("vector", "salt").orderBy("id")
    salted = own.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).distinct()
    first = salted.withColumn("place", F.row_number().over(by_vector)).where(F.col("place") <= k + 1)
    classes = checkpointed(first.groupBy("vector").agg(
        F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")))
    total = classes.count()
    taken = classes.orderBy(F.xxhash64("vector"), F.col("ids")[0]).limit(sample).select("vector").toArrow()
    sampled = _matrix(taken["vector"].combine_chunks())
    top = _top_tree(sampled, min(max(-(-total // shard_rows), 1), most_leaves))
    leaves = _leaves(top)
    centers = top.center[leaves]

    @F.arrow_udf("long")
    def home(vectors: pa.Array) -> pa.Array:
        """The leaf of the nearest center; a bounded matrix at a time."""
        found = []
        matrix = _matrix(vectors)
        for at in range(0, len(matrix), 2048):
            some = matrix[at:at + 2048]
            found.append(((centers ** 2).sum(1) - 2 * some @ centers.T).argmin(axis=1))
        return pa.array(np.concatenate(found) if found else np.zeros(0, np.int64), pa.int64())

    width = k + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One packed tree for the rows of each shard, which arrive in order, and how far its
        vectors are from the center of their leaf."""
        held: dict[int, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for shard, parts in held.items():
                whole = np.concatenate([p[0] for p in parts])
                ids = np.full((len(whole), width), MISSING, dtype=np.int64)
                for row, some in enumerate(x for p in parts for x in p[1]):
                    ids[row, :len(some)] = some
                vectors = whole.astype(np.float64)
                radius = np.sqrt(((vectors - centers[shard % len(centers)]) ** 2).sum(axis=1).max())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.array([BallTree.build(vectors).pack(whole, ids)], pa.binary()),
                     pa.array([float(radius)], pa.float64())], ["shard", "tree", "radius"])
            held.clear()

        for batch in batches:
            numbers = batch["shard"].to_numpy()
            for shard in np.unique(numbers).tolist():
                if shard not in held:
                    yield from flush()
                some = batch.filter(pa.array(numbers == shard))
                held.setdefault(shard, []).append((_whole(some["vector"]), some["ids"].to_pylist()))
        yield from flush()

    placed = checkpointed(classes.withColumn("leaf", home("vector")))
    # At most `most_leaves` rows: how many shards a leaf is cut into.
    cut = spark.createDataFrame(
        [(r["leaf"], -(-r["count"] // shard_rows)) for r in placed.groupBy("leaf").count().collect()],
        "leaf long, shards long")

    def in_shards(df: DataFrame, by: str) -> DataFrame:
        """Add `shard`, the leaf plus the number of leaves times a hash."""
        parts = F.coalesce("shards", F.lit(1))
        return df.join(F.broadcast(cut), "leaf", "left").withColumn(
            "shard", F.col("leaf") + len(centers) * F.pmod(F.xxhash64(by), parts))

    dealt = in_shards(placed, "vector").select("shard", "vector", "ids")
    trees = checkpointed(dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        build, "shard long, tree binary, radius double"))
    asked = own.where("asks").select("id", "vector", home("vector").alias("leaf"))
    queries = checkpointed(in_shards(asked, "id").select("id", "vector", "shard"))
    query_parts = max(-(-queries.count() // query_rows), 1)

    def search(asked: DataFrame) -> DataFrame:
        """Search (id, vector, shard, known); queries of a shard are cut into parts."""
        parts = asked.select(
            "shard", F.pmod(F.xxhash64("id"), F.lit(query_parts)).cast("int").alias("part"),
            F.lit(1).alias("role"), "id", "vector", "known", F.lit(None).cast("binary").alias("tree"))
        visited = parts.select("shard", "part").distinct()
        stored = trees.join(visited, "shard").select(
            "shard", "part", F.lit(0).alias("role"), F.lit(None).cast("long").alias("id"),
            F.lit(None).cast("array<bigint>").alias("vector"), F.lit(None).cast("long").alias("known"), "tree")
        both = stored.unionByName(parts).repartition("shard", "part")
        return both.sortWithinPartitions("shard", "part", "role", "id").mapInArrow(
            lambda batches: _search(batches, k), "query_id long, vec_id long, score long")

    at_home = checkpointed(search(queries.withColumn("known", F.lit(None).cast("long"))))
    kth = _ranked(at_home, k).where(F.col("rank") == k).select(
        F.col("query_id").alias("id"), F.col("score").alias("known"))
    # One row per leaf, at most `most_leaves`.
    balls = trees.groupBy((F.col("shard") % len(centers)).alias("leaf")).agg(F.max("radius").alias("radius")).toArrow()
    numbers, radii = balls["leaf"].to_numpy(), balls["radius"].to_numpy()
    middles = centers[numbers]

    @F.arrow_udf("array<long>")
    def reached(vectors: pa.Array, known: pa.Array) -> pa.Array:
        """Leaves whose ball can hold a score of at least the known one."""
        found: list[np.ndarray] = []
        matrix, least = _matrix(vectors), _known(known)
        for at in range(0, len(matrix), 1024):
            some = matrix[at:at + 1024]
            lengths = np.sqrt((some * some).sum(axis=1))[:, None]
            bound = some @ middles.T + lengths * radii
            bound += 1e-6 * (np.abs(bound) + lengths * radii + 1)
            found += [numbers[row] for row in bound >= least[at:at + 1024, None]]
        return pa.array(found, pa.list_(pa.int64()))

    far = queries.join(kth, "id", "left").withColumnRenamed("shard", "home")
    leaves_of = far.select("id", "vector", "known", "home", F.explode(reached("vector", "known")).alias("leaf"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1))
    visits = leaves_of.join(F.broadcast(cut), "leaf").select("*", number.alias("part")).withColumn(
        "shard", F.col("leaf") + len(centers) * F.col("part")).where(F.col("shard") != F.col("home"))
    away = search(visits.select("id", "vector", "known", "shard"))
    return at_home.unionByName(away)


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    shard, key = None, None
    for batch in batches:
        found: list[tuple[int, int, int]] = []
        numbers, parts = batch["shard"].to_numpy(), batch["part"].to_numpy()
        roles = batch["role"].to_numpy()
        change = np.flatnonzero(
            (numbers[1:] != numbers[:-1]) | (parts[1:] != parts[:-1]) | (roles[1:] != roles[:-1])) + 1
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            if a == b:
                continue
            group = (int(numbers[a]), int(parts[a]))
            if roles[a] == 0:
                shard, key = Shard(batch["tree"][a].as_py()), group
            elif group == key:  # else no vector is stored there
                some = batch.slice(a, b - a)
                found += shard.search(
                    some["id"].to_numpy(), _whole(some["vector"]), _known(some["known"]), k)
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "score"])
