"""Embedding near-duplicates by product quantisation.

1. Vectors that are null, zero, empty or hold null or non-finite components link with nothing, and
   vectors of different lengths don't link; each length is searched on its own. Equal vectors
   collapse to one row with a weight.
2. Unit vectors are put into inverted lists by their nearest coarse centroid; the residual
   is coded by one codeword per subspace. Centroids and codebooks are fitted on at most
   `sample` vectors chosen by a hash; every vector is indexed.
3. cosine >= t means a distance of at most r = sqrt(2 - 2t). A vector probes its own list and
   the lists whose border with its own is near enough. How near is measured: where links of the
   sample cross a list's border, as in a dense group that spans many lists, it is `margin` times the
   most that any such link needs, up to r, which loses no link. For the other lists it is 3 standard
   deviations of what a displacement of length r does across a border, r / sqrt(dimension). A
   link is found if either of its vectors probes the other's list.
4. In a list the distance of a query to a coded vector comes from lookup tables. A vector
   whose code is further from the query than r plus the vector's coding error cannot link.
   The others are reranked by exact cosine in double precision.
5. A list with many vectors or queries is cut into parts by a hash, and each pair of parts
   is a group of its own. A group returns the number of links of each query and only the
   links that join different parts of the graph. Components come from contraction.
"""

from __future__ import annotations

import dataclasses
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed, connected_components

CHUNK = 1 << 18  # query-vector pairs looked at together
SIGMAS = 3.0  # least border, in standard deviations


@dataclasses.dataclass(frozen=True)
class Quantiser:
    centroids: np.ndarray  # lists x dimension
    codebooks: np.ndarray  # subspaces x codewords x width; the last subspace is zero-padded
    dimension: int
    reach: float = 0.0  # distance of vectors that link, at most
    border: np.ndarray | None = None  # per list: how near its border a vector is for the other side to matter

    @property
    def width(self) -> int:
        return self.codebooks.shape[2]

    def _padded(self, vectors: np.ndarray) -> np.ndarray:
        spare = self.width * len(self.codebooks) - self.dimension
        return np.pad(vectors, ((0, 0), (0, spare)))

    @functools.cached_property
    def apart(self) -> np.ndarray:
        """Distances between centroids."""
        return np.sqrt(_square_distances(self.centroids, self.centroids))

    @functools.cached_property
    def excess(self) -> np.ndarray:
        """By how much the square distance to a list may exceed that to the own list."""
        return 2 * self.apart * np.maximum(self.border[:, None], self.border) + 1e-9

    def lists(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Own list of each vector, and a matrix of the lists it probes."""
        squares = _square_distances(unit, self.centroids)
        own = squares.argmin(axis=1)
        probes = squares - squares[np.arange(len(unit)), own][:, None] <= self.excess[own]
        probes[np.arange(len(unit)), own] = True
        return own, probes

    def encode(self, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the coding error of each."""
        parts = self._padded(residuals)
        codes = np.empty((len(parts), len(self.codebooks)), dtype=np.uint8)
        error = np.zeros(len(parts))
        for m, book in enumerate(self.codebooks):
            squares = _square_distances(parts[:, m * self.width:(m + 1) * self.width], book)
            codes[:, m] = squares.argmin(axis=1)
            error += squares.min(axis=1)
        return codes, np.sqrt(error)

    def tables(self, residuals: np.ndarray) -> np.ndarray:
        """Square distances of queries to codewords: queries x subspaces x codewords."""
        parts = self._padded(residuals)
        return np.stack([
            _square_distances(parts[:, m * self.width:(m + 1) * self.width], book)
            for m, book in enumerate(self.codebooks)
        ], axis=1)


def _square_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def _kmeans(rows: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Centroids; starts from evenly spaced rows, which come in hash order."""
    centers = rows[np.linspace(0, len(rows) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = _square_distances(rows, centers).argmin(axis=1)
        amount = np.bincount(own, minlength=k)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        centers = np.where(amount[:, None] > 0, sums / np.maximum(amount, 1)[:, None], centers)
    return centers


def fit_quantiser(unit: np.ndarray, lists: int, subspaces: int = 8, codewords: int = 64) -> Quantiser:
    """Fit on sampled unit vectors."""
    dimension = unit.shape[1]
    centroids = np.unique(_kmeans(unit, min(lists, len(unit))), axis=0)
    residuals = unit - centroids[_square_distances(unit, centroids).argmin(axis=1)]
    width = -(-dimension // subspaces)
    padded = np.pad(residuals, ((0, 0), (0, width * subspaces - dimension)))
    books = [_kmeans(padded[:, m * width:(m + 1) * width], min(codewords, len(unit)))
             for m in range(subspaces)]
    return Quantiser(centroids, np.stack(books), dimension)


def needed_border(quantiser: Quantiser, unit: np.ndarray, threshold: float) -> tuple[float, np.ndarray]:
    """Largest border that a link between lists needs, and which lists such links touch."""
    squares = _square_distances(unit, quantiser.centroids)
    own, most = squares.argmin(axis=1), 0.0
    touched = np.zeros(len(quantiser.centroids), dtype=bool)
    for at in range(0, len(unit), 512):
        row, col = np.nonzero(unit[at:at + 512] @ unit[at:].T >= threshold)
        row, col = row + at, col + at
        across = own[row] != own[col]
        row, col = row[across], col[across]
        if len(row):
            touched[own[row]] = touched[own[col]] = True
            there = squares[row, own[col]] - squares[row, own[row]]
            back = squares[col, own[row]] - squares[col, own[col]]
            apart = quantiser.apart[own[row], own[col]]
            most = max(most, float((np.minimum(there, back) / (2 * apart)).max()))
    return most, touched


def with_borders(quantiser: Quantiser, unit: np.ndarray, threshold: float, margin: float) -> Quantiser:
    """Set the borders for a cosine threshold from the links among the sample."""
    reach = float(np.sqrt(max(2 - 2 * threshold, 0))) + 1e-9
    usual = min(SIGMAS / np.sqrt(quantiser.dimension), 1.0) * reach
    most, touched = needed_border(quantiser, unit, threshold)
    border = np.where(touched, min(max(usual, margin * most), reach), usual)
    return dataclasses.replace(quantiser, reach=reach, border=border)


def usable(vector: str) -> F.Column:
    """Whether a vector column is not null or zero and all components are finite."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    values = np.asarray(column.flatten(), dtype=np.float64)
    return values.reshape(len(column), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def embedding_components(rows: DataFrame, threshold: float = 0.95, id_col: str = "vec_id",
                         vector_col: str = "embedding", sample: int = 20_000, list_rows: int = 256,
                         most_lists: int = 1024, part_rows: int = 4096, margin: float = 1.25) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    n_links counts other rows, equal vectors included; component_id is the smallest id that
    links reach. Repeated rows count as separate rows. Rows with a null id take no part:
    n_links 0, component_id null, kept false.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    good = own.where(usable("vector") & F.col("id").isNotNull())
    classes = checkpointed(good.groupBy("vector").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("weight")))
    found = spark.createDataFrame([], "u long, v long, n long")
    for r in classes.select(F.size("vector").alias("n")).distinct().orderBy("n").collect():
        same = classes.where(F.size("vector") == r["n"])
        found = found.unionByName(checkpointed(
            _class_links(same, threshold, sample, list_rows, most_lists, part_rows, margin)))
    linked = found.groupBy("u").agg(F.sum("n").alias("n"))
    roots = connected_components(found.where(F.col("v").isNotNull()).select("u", "v"))
    rooted = (
        classes.join(linked, F.col("rep") == F.col("u"), "left")
        .join(roots, F.col("rep") == F.col("vertex"), "left")
        .withColumn("root", F.coalesce("root", "rep"))
    )
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    answers = rooted.join(least, "root").select(
        F.col("vector").alias("like"), "component_id",
        (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    joined = own.join(answers, (F.col("vector") == F.col("like")) & F.col("id").isNotNull(), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(
        "id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"),
    )


def _class_links(classes: DataFrame, threshold: float, sample: int, list_rows: int, most_lists: int,
                 part_rows: int, margin: float) -> DataFrame:
    """(u, v, n): the number n of rows that u links with where v is null, else a spanning link."""
    taken = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vector").toArrow()
    lists = min(max(classes.count() // list_rows, 1), most_lists)
    unit = _unit(_matrix(taken["vector"].combine_chunks()))
    quantiser = with_borders(fit_quantiser(unit, lists), unit, threshold, margin)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the own list (role 0) and for every probed list (role 1)."""
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                base, probes = quantiser.lists(_unit(_matrix(piece["vector"])))
                row, cell = np.nonzero(probes)
                index = np.concatenate([np.arange(piece.num_rows), row])
                placed = piece.take(pa.array(index))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([base, cell]).astype(np.int64)),
                     pa.array(np.repeat([0, 1], [piece.num_rows, len(row)]).astype(np.int32)),
                     pa.array(base[index].astype(np.int64)), placed["rep"], placed["weight"],
                     placed["vector"]],
                    ["cell", "role", "home", "rep", "weight", "vector"])

    id_type = classes.schema["rep"].dataType.simpleString()
    placed = classes.select("rep", "weight", "vector").mapInArrow(
        place, f"cell long, role int, home long, rep {id_type}, weight long, vector array<double>")
    # At most `most_lists` lists, so their sizes can be broadcast.
    sizes = placed.groupBy("cell").agg(
        F.ceil(F.sum(F.when(F.col("role") == 0, 1).otherwise(0)) / part_rows).cast("int").alias("parts"),
        F.ceil(F.sum("role") / (2 * part_rows)).cast("int").alias("query_parts"),
    )
    sized = placed.join(F.broadcast(sizes), "cell")
    is_query = F.col("role") == 1
    own_part = F.pmod(F.xxhash64("rep"), F.when(is_query, F.col("query_parts")).otherwise(F.col("parts")))
    # A list no vector of which is stored has no parts; its queries meet nothing.
    all_other = F.sequence(F.lit(0), F.when(is_query, F.col("parts")).otherwise(F.col("query_parts")) - 1)
    met = sized.where((F.col("parts") > 0) & (F.col("query_parts") > 0)).select(
        "cell", "role", "home", "rep", "weight", "vector", own_part.cast("int").alias("own"),
        F.explode(all_other).alias("other"))
    order = ["cell", "part", "query_part"]
    groups = met.select(
        "cell", F.when(is_query, F.col("other")).otherwise(F.col("own")).alias("part"),
        F.when(is_query, F.col("own")).otherwise(F.col("other")).alias("query_part"),
        "role", "home", "rep", "weight", "vector",
    ).repartition(*order).sortWithinPartitions(*order, "role", "rep")
    return groups.mapInArrow(
        lambda batches: _search_groups(batches, quantiser, threshold),
        f"u {id_type}, v {id_type}, n long")


class _ListPart:
    """The stored vectors of one group; queries stream past."""

    def __init__(self, cell: int, quantiser: Quantiser):
        self.cell, self.quantiser = cell, quantiser
        self.ids: list[np.ndarray] = []
        self.weights: list[np.ndarray] = []
        self.vectors: list[np.ndarray] = []
        self.ready = False

    def store(self, ids: np.ndarray, weights: np.ndarray, vectors: np.ndarray) -> None:
        self.ids.append(ids)
        self.weights.append(weights)
        self.vectors.append(_unit(vectors))

    def _prepare(self) -> None:
        self.all_ids = np.concatenate(self.ids)
        self.all_weights = np.concatenate(self.weights)
        self.units = np.concatenate(self.vectors)
        residuals = self.units - self.quantiser.centroids[self.cell]
        self.codes, self.error = self.quantiser.encode(residuals)
        self.root = np.arange(len(self.all_ids))
        self.ready = True

    def _top(self, k: int) -> int:
        while self.root[k] != k:
            self.root[k] = k = self.root[self.root[k]]
        return k

    def _reversed(self, homes: np.ndarray, col: np.ndarray) -> np.ndarray:
        """Whether stored vectors probe the own lists of the queries that found them."""
        here, there = self.quantiser.centroids[self.cell], self.quantiser.centroids[homes]
        own = ((self.units[col] - here) ** 2).sum(axis=1)
        other = ((self.units[col] - there) ** 2).sum(axis=1)
        return (homes == self.cell) | (other - own <= self.quantiser.excess[self.cell, homes])

    def search(self, ids: np.ndarray, weights: np.ndarray, homes: np.ndarray, vectors: np.ndarray,
               threshold: float) -> tuple[list, list, list]:
        """Links of queries with the stored vectors, counted for both unless both find them."""
        u, v, n = [], [], []
        if not self.ids:
            return u, v, n
        if not self.ready:
            self._prepare()
        step = max(1, CHUNK // len(self.all_ids))
        for at in range(0, len(ids), step):
            some, units = ids[at:at + step], _unit(vectors[at:at + step])
            tables = self.quantiser.tables(units - self.quantiser.centroids[self.cell])
            squares = np.zeros((len(some), len(self.all_ids)))
            for m in range(self.codes.shape[1]):  # asymmetric distances by table lookup
                squares += tables[:, m][:, self.codes[:, m]]
            near = np.sqrt(squares) <= self.quantiser.reach + self.error + 1e-9
            near &= some[:, None] != self.all_ids
            row, col = np.nonzero(near)
            cosine = np.einsum("ij,ij->i", units[row], self.units[col])  # exact rerank
            row, col = row[cosine >= threshold], col[cosine >= threshold]
            once = ~self._reversed(homes[at:at + step][row], col)
            total = np.bincount(row, self.all_weights[col], len(some)).astype(np.int64)
            back = np.bincount(col[once], weights[at:at + step][row[once]], len(self.all_ids)).astype(np.int64)
            for owner, amount in ((some, total), (self.all_ids, back)):
                told = np.flatnonzero(amount)
                u += owner[told].tolist()
                v += [None] * len(told)
                n += amount[told].tolist()
            ends = np.searchsorted(row, np.arange(len(some) + 1))
            for k in np.flatnonzero(np.diff(ends)).tolist():
                met = col[ends[k]:ends[k + 1]]
                tops = np.array(sorted({self._top(c) for c in np.unique(self.root[met]).tolist()}))
                for top in tops.tolist():
                    u.append(int(some[k]))
                    v.append(int(next(self.all_ids[c] for c in met.tolist() if self._top(c) == top)))
                    n.append(0)
                self.root[tops] = tops[0]
        return u, v, n


def _search_groups(batches: Iterator[pa.RecordBatch], quantiser: Quantiser,
                   threshold: float) -> Iterator[pa.RecordBatch]:
    part, key = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = [batch[c].to_numpy() for c in ("cell", "part", "query_part", "role")]
        change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1
        reps, weights, homes = (batch[c].to_numpy() for c in ("rep", "weight", "home"))
        vectors = _matrix(batch["vector"])
        for a, b in zip([0, *change.tolist()], [*change.tolist(), batch.num_rows]):
            group = tuple(int(x[a]) for x in ids[:3])
            if group != key:
                part, key = _ListPart(group[0], quantiser), group
            if ids[3][a] == 0:
                part.store(reps[a:b], weights[a:b], vectors[a:b])
            else:
                u, v, n = part.search(
                    reps[a:b], weights[a:b], homes[a:b], vectors[a:b], threshold)
                kind = batch.schema.field("rep").type
                yield pa.RecordBatch.from_arrays(
                    [pa.array(u, kind), pa.array(v, kind), pa.array(n, pa.int64())], ["u", "v", "n"])
