"""Ranked lexical search for a set of items over all documents, by classes of equal bags.

Terms are the maximal runs of ASCII letters, digits and characters beyond ASCII; A-Z are
lower-cased. A document's score for an item is a sum over the item's distinct terms of whole
numbers made of the term's weight, its occurrences and the document's length (`impacts`).

1. The items' terms are the vocabulary. A document is reduced to its bag: the vocabulary terms it
   holds and how often (`bag`), and its number of terms, which gives its length class m.
2. Documents with the same bag and m have the same scores. They meet by a hash; bag and m are part
   of the key, so classes are verified. Of a class only the `k` smallest ids can be among an
   item's best, and Spark drops the others before it shuffles.
3. Every class is scored once, over posting lists of the items. A task keeps the `k` best classes
   per item; classes come in order of their smallest id, so of equals the first ones stay.
4. The classes kept are expanded in ascending order of id and ranked.

Items are dealt to blocks of about `block_terms` (item, term) pairs, which is what the tasks
hold; with more items the documents are read once per block.

Defined results: a null or empty text has no terms and is never found; an item without terms finds
nothing. Rows that share an item id are one item with the terms of all. Every row of the documents
is a document: repeated rows are ranked each; null ids come last among equals. Null item ids are
an item.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed

CELLS = 1 << 22  # scores or contributions a task holds at once


def _term_bytes() -> bytes:
    """Translation of bytes: ASCII letters to lower case, digits and bytes of characters beyond
    ASCII to themselves, all others to a space."""
    kept = b"0123456789abcdefghijklmnopqrstuvwxyz"
    table = bytearray(b" " * 128) + bytes(range(128, 256))
    for upper, lower in zip(kept.upper(), kept):
        table[upper] = table[lower] = lower
    return bytes(table)


TERM_BYTES = _term_bytes()


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TERM_BYTES).split()


def terms_column(text: Column | str) -> Column:
    """The distinct terms of a text."""
    @F.arrow_udf("array<string>")
    def distinct(values: pa.Array) -> pa.Array:
        found = [sorted(set(terms(v.as_py()))) for v in values.cast(pa.binary())]
        return pa.array(found, pa.list_(pa.binary())).cast(pa.list_(pa.string()))

    return distinct(text)


def bag(text: bytes | None, vocabulary: dict[bytes, int]) -> tuple[int, bytes]:
    """Number of terms, and (place in the vocabulary, occurrences) as pairs of uint32, by place."""
    words = terms(text)
    held = Counter(map(vocabulary.get, words))
    held.pop(None, None)
    return len(words), np.array(sorted(held.items()), dtype="<u4").tobytes()


def bags_column(text: Column | str, vocabulary: Callable[[], dict[bytes, int]]) -> Column:
    @F.arrow_udf("struct<n: bigint, bag: binary>")
    def bags(values: pa.Array) -> pa.Array:
        known = vocabulary()
        pairs = [bag(v.as_py(), known) for v in values.cast(pa.binary())]
        return pa.StructArray.from_arrays([
            pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.binary()),
        ], names=["n", "bag"])

    return bags(text)


def _unpacked(bags: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, occurrences) of all entries."""
    sizes = np.array([len(b) // 8 for b in bags.to_pylist()], dtype=np.int64)
    pairs = np.frombuffer(b"".join(bags.to_pylist()), dtype="<u4").reshape(-1, 2).astype(np.int64)
    return np.repeat(np.arange(len(sizes)), sizes), pairs[:, 0], pairs[:, 1]


def document_frequencies(bags: DataFrame, size: int) -> np.ndarray:
    """Number of documents per place of a vocabulary of `size` terms."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_unpacked(batch["bag"])[1], minlength=size)
        places = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(total[places])], ["place", "df"])

    rows = bags.select("bag").mapInArrow(counted, "place long, df long").groupBy("place").agg(F.sum("df"))
    found = np.zeros(size, dtype=np.int64)
    for place, df in rows.collect():  # at most the vocabulary of a block
        found[place] = df
    return found


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def impacts(weights: np.ndarray, occurrences: np.ndarray, m: np.ndarray) -> np.ndarray:
    return weights * ((1_000_000_000 * occurrences) // (1000 * occurrences + 8 * m))


class Postings:
    """Items per term of a block, with the terms' weights."""

    def __init__(self, items: np.ndarray, places: np.ndarray, weights: np.ndarray, count: int):
        order = np.argsort(places, kind="stable")
        self.items, self.weights, self.count = items[order], weights, count
        self.sizes = np.bincount(places, minlength=len(weights))
        self.starts = np.cumsum(self.sizes) - self.sizes

    def scores(self, rows: int, row: np.ndarray, place: np.ndarray, impact: np.ndarray) -> np.ndarray:
        """(rows, items) sums. All are whole numbers below 2^53, so doubles hold them exactly."""
        sizes = self.sizes[place]
        first = np.repeat(self.starts[place] - (np.cumsum(sizes) - sizes), sizes)
        items = self.items[first + np.arange(len(first))]
        cells = np.repeat(row, sizes) * self.count + items
        sums = np.bincount(cells, weights=np.repeat(impact, sizes), minlength=rows * self.count)
        return sums.reshape(rows, self.count).astype(np.int64)

    def slices(self, rows: int, row: np.ndarray, place: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs of rows with at most about CELLS scores and contributions."""
        own = np.bincount(row, weights=self.sizes[place], minlength=rows) + self.count
        start, held = 0, 0
        for r, cost in enumerate(own):
            if r > start and held + cost > CELLS:
                yield start, r
                start, held = r, 0
            held += cost
        if rows > start:
            yield start, rows


def best_classes(batches: Iterator[pa.RecordBatch], postings: Postings, k: int,
                 kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Per item the `k` best of the classes that a task sees, equals in order of arrival."""
    score = np.zeros((k, postings.count), dtype=np.int64)
    place = np.full((k, postings.count), -1, dtype=np.int64)
    members: dict[int, list] = {}
    arrived = 0
    for batch in batches:
        row, term, occurrences = _unpacked(batch["bag"])
        impact = impacts(postings.weights[term], occurrences, batch["m"].to_numpy()[row])
        ids = batch["members"].to_pylist()
        for a, b in postings.slices(len(ids), row, term):
            own = slice(*np.searchsorted(row, [a, b]))
            new = postings.scores(b - a, row[own] - a, term[own], impact[own])
            better = np.flatnonzero((new > score[-1]).any(axis=0))
            if not len(better):
                continue
            numbers = np.broadcast_to(np.arange(arrived + a, arrived + b)[:, None], (b - a, len(better)))
            every = np.concatenate([score[:, better], new[:, better]])
            places = np.concatenate([place[:, better], numbers])
            top = np.argsort(-every, axis=0, kind="stable")[:k]
            score[:, better] = np.take_along_axis(every, top, axis=0)
            place[:, better] = np.where(score[:, better] > 0, np.take_along_axis(places, top, axis=0), -1)
            left = set(np.unique(place).tolist())
            members = {p: x for p, x in members.items() if p in left} | {
                p: ids[p - arrived] for p in left if p >= arrived + a}
        arrived += len(ids)
    rank, item = np.nonzero(score)
    held = [members[p] for p in place[rank, item].tolist()]
    yield pa.RecordBatch.from_arrays(
        [pa.array(item, pa.int64()), pa.array(score[rank, item], pa.int64()), pa.array(held, kind)],
        ["item", "score", "members"])


def classes(bags: DataFrame, documents: int, occurrences: int, k: int) -> DataFrame:
    """(m, bag, members): classes of documents with equal bag and m, and their `k` smallest ids."""
    length = F.expr(f"10 + (90 * n * {documents}L) div {max(occurrences, 1)}L")
    told = bags.where(F.octet_length("bag") > 0).select("id", length.alias("m"), "bag")
    keys = ["digest", "m", "bag"]
    hashed = told.withColumn("digest", F.xxhash64("bag", "m"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.asc_nulls_last("id")))
    first = hashed.withColumn("place", place).where(F.col("place") <= k)
    ids = F.array_sort(F.collect_list(F.struct("place", "id")))
    return first.groupBy(*keys).agg(ids.alias("members")).select("m", "bag", F.col("members.id").alias("members"))


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text: str = "text", block_terms: int = 200_000) -> DataFrame:
    """(item, rank, id, score): the `k` best documents of every item with a score above zero."""
    spark = docs.sparkSession
    pairs = checkpointed(items.select(
        F.col(item_col).alias("item_id"), F.explode(terms_column(F.col(item_text))).alias("term")).distinct())
    blocks = max(1, math.ceil(pairs.count() / block_terms))
    dealt = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    totals: tuple[int, int] | None = None
    found: DataFrame | None = None
    for block in range(blocks):
        held = [(r["item_id"], r["term"].encode()) for r in pairs.where(dealt == block).collect()]
        words = {w: p for p, w in enumerate(sorted({w for _, w in held}))}
        numbers = {x: p for p, x in enumerate(dict.fromkeys(x for x, _ in held))}
        shared = spark.sparkContext.broadcast(words)
        bags = checkpointed(docs.select(
            F.col(id_col).alias("id"), bags_column(F.col(text_col), lambda s=shared: s.value).alias("b"),
        ).select("id", "b.*").where("n > 0"))
        if totals is None:
            totals = tuple(bags.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first())
        frequencies = document_frequencies(bags, len(words))
        postings = spark.sparkContext.broadcast(Postings(
            np.array([numbers[x] for x, _ in held], dtype=np.int64),
            np.array([words[w] for _, w in held], dtype=np.int64),
            np.array([weight(totals[0], df) for df in frequencies.tolist()], dtype=np.int64), len(numbers)))
        known = classes(bags, *totals, k)
        kind = pa.list_(_arrow_type(docs, id_col))
        top = known.sortWithinPartitions(F.asc_nulls_last(F.col("members")[0])).mapInArrow(
            lambda batches, p=postings, t=kind: best_classes(batches, p.value, k, t),
            f"item long, score long, members array<{docs.schema[id_col].dataType.simpleString()}>")
        ids = spark.createDataFrame(
            [(p, x) for x, p in numbers.items()], f"item long, item_id {items.schema[item_col].dataType.simpleString()}")
        own = top.join(ids, "item").select("item_id", "score", F.explode("members").alias("id"))
        found = own if found is None else found.unionByName(own)
    order = W.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "id", "score")


def _arrow_type(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)
