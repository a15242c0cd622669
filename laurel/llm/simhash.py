"""SimHash near-duplicates with pivot distance tables.

Fingerprint: A-Z are lower-cased, words are runs of bytes other than ASCII white space, a
shingle is four words joined by a space (repeats included; a text with fewer words is one
shingle), and a bit is set if it is set in over half of the shingles' XXH64 hashes with
seed 42. A null text or one without words has fingerprint zero and is treated as any other.

Links: two fingerprints are linked if they differ in at most `max_bits` bits.

1. Equal fingerprints collapse to one row, so copies cost nothing.
2. Fingerprints meet by keys: two fingerprints at distance d agree on at least `blocks - d` of
   `blocks` bit blocks, so they share the value of some choice of `blocks - max_bits` blocks
   (`block_masks`); this brings together every linked pair.
3. A pivot table holds the Hamming distance of every fingerprint to reference fingerprints.
   By the triangle inequality linked fingerprints differ by at most `max_bits` in every
   coordinate: pairs that share a key are discarded by their largest coordinate difference
   and the survivors verified by counting differing bits.
4. A key with many fingerprints is cut into parts by a hash; every pair of parts is a group of
   its own. A group returns only links that join different parts of the graph (at most one
   less than its rows), so no group emits all pairs. Nothing is capped.
5. Components are found by contraction (`components`).
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed, connected_components

WORDS = 4
SEED = 42
BITS = 64


def _mixed(hashes: np.ndarray, turn: int) -> np.ndarray:
    """Further hashes of the same shingles; turn 0 gives them unchanged."""
    if not turn:
        return hashes
    z = hashes + np.uint64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def shingle_hashes(text: str | None, words: int = WORDS) -> np.ndarray:
    """XXH64 of every shingle in order, repeats included; none for a text without words."""
    parts = (text or "").encode("utf-8").lower().split()  # bytes: ASCII case and white space
    if not parts:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(words, len(parts))
    firsts, lasts = starts[: len(parts) - size + 1].tolist(), ends[size - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter(
        (digest(data[a:b], SEED) for a, b in zip(firsts, lasts)), dtype=np.uint64, count=len(firsts)
    )


def fingerprints(text: str | None, words: int = WORDS, width: int = 1) -> list[int]:
    """SimHash of one text in `width` signed 64-bit integers."""
    hashes = shingle_hashes(text, words)
    if not len(hashes):
        return [0] * width
    found = []
    for turn in range(width):
        counts = np.zeros(BITS, dtype=np.int64)
        for at in range(0, len(hashes), 4096):  # bounded memory for very long texts
            some = _mixed(hashes[at:at + 4096], turn).astype("<u8").view(np.uint8).reshape(-1, 8)
            counts += np.unpackbits(some, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        bits = np.packbits(2 * counts > len(hashes), bitorder="little")
        found.append(int(bits.view("<i8")[0]))
    return found


def fingerprint(text: str | None, words: int = WORDS) -> int:
    return fingerprints(text, words)[0]


def fingerprint_column(text: Column | str, words: int = WORDS, width: int = 1) -> Column:
    """Array of `width` integers."""

    @F.arrow_udf("array<bigint>")
    def simhash(values: pa.Array) -> pa.Array:
        return pa.array((fingerprints(v.as_py(), words, width) for v in values), type=pa.list_(pa.int64()))

    return simhash(text)


def hex_digits(value: Column | str) -> Column:
    return F.lower(F.lpad(F.hex(value), BITS // 4, "0"))


def pivots(count: int = 16, width: int = 1) -> list[list[int]]:
    """Reference fingerprints, as signed integers."""
    raw = np.array([xxhash.xxh64_intdigest(f"pivot {k}", SEED) for k in range(count * width)], dtype="<u8")
    return raw.view("<i8").reshape(count, width).tolist()


def pivot_table(prints: DataFrame, references: list[list[int]]) -> DataFrame:
    """Add `table`: the Hamming distances of `fp` to the references, four to an integer."""
    packed = []
    for at in range(0, len(references), 4):
        total = F.lit(0).cast("bigint")
        for k, reference in enumerate(references[at:at + 4]):
            distance = sum(
                (F.bit_count(F.col("fp")[w].bitwiseXOR(F.lit(p))) for w, p in enumerate(reference)), F.lit(0))
            total = total.bitwiseOR(F.shiftleft(distance.cast("bigint"), 16 * k))
        packed.append(total)
    return prints.withColumn("table", F.array(*packed))


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(blocks: int, max_bits: int) -> list[list[int]]:
    """Masks of every choice of blocks - max_bits bit blocks of one integer."""
    if blocks <= max_bits:
        raise ValueError("blocks must exceed max_bits")
    edges = [round(k * BITS / blocks) for k in range(blocks + 1)]
    return [
        [_signed(sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen))]
        for chosen in itertools.combinations(range(blocks), blocks - max_bits)
    ]


def blocks_for(rows: int, max_bits: int, key_cost: int = 2000) -> int:
    """Number of blocks with the least work for so many fingerprints.

    More blocks give wider keys, which fewer unlike fingerprints share, but more keys a row.
    Writing and sorting a key costs about as much as comparing `key_cost` fingerprints. The
    links are the same for any number.
    """
    def work(blocks: int) -> float:
        keys = math.comb(blocks, max_bits)
        return keys * (key_cost + rows / 2 ** (BITS * (blocks - max_bits) / blocks))

    return min(range(max_bits + 1, max_bits + 7), key=work)


def fingerprint_links(prints: DataFrame, masks: list[list[int]], max_bits: int = 4,
                      references: int = 16, part_rows: int = 4096) -> DataFrame:
    """Links (u, v) that connect what pairs of fingerprints at `max_bits` that share a key connect.

    `prints` has a distinct number `node` and the fingerprint `fp` (an array). A key with
    over `part_rows` fingerprints is cut into parts by a hash, and every pair of parts is a
    group of its own.
    """
    width = len(masks[0])
    keys = F.array(*[
        F.xxhash64(F.lit(k), *[F.col("fp")[w].bitwiseAND(F.lit(m)) for w, m in enumerate(mask) if m])
        for k, mask in enumerate(masks)
    ])
    table = checkpointed(pivot_table(prints.select("node", "fp"), pivots(references, width)))
    keyed = table.select("node", F.explode(keys).alias("key"))
    shared = keyed.groupBy("key").count().where("count > 1")
    met = keyed.join(shared, "key")
    parts = F.ceil(F.col("count") / part_rows).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int")
    groups = met.select(
        "key", "node", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"),
    ).select(
        "key", "node", F.least("own", "other").alias("part"), F.greatest("own", "other").alias("with"),
    ).join(table, "node")
    order = ["key", "part", "with"]
    dealt = groups.repartition(*order).sortWithinPartitions(*order, "node")
    return dealt.mapInArrow(lambda rows: _joined_groups(rows, order, max_bits), "u long, v long").distinct()


def _joined_groups(batches: Iterator[pa.RecordBatch], order: list[str],
                   max_bits: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of sorted groups; the last group of a batch waits for the next batch."""
    held: pa.Table | None = None

    def links(table: pa.Table) -> pa.RecordBatch:
        ids = [table[c].to_numpy() for c in order]
        fresh = np.ones(table.num_rows, dtype=bool)
        if table.num_rows:
            fresh[1:] = np.any([c[1:] != c[:-1] for c in ids], axis=0)
        nodes = table["node"].to_numpy()
        words = _rows(table["fp"], np.uint64)
        distances = np.ascontiguousarray(_rows(table["table"], np.int64)).view(np.int16)
        u, v = spanning_links(np.cumsum(fresh), nodes, words, distances, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table]).combine_chunks()
        if not table.num_rows:
            continue
        same = np.ones(table.num_rows, dtype=bool)
        for c in order:
            values = table[c].to_numpy()
            same &= values == values[-1]
        start = table.num_rows - int(same.sum())
        if start:
            yield links(table.slice(0, start))
        held = table.slice(start)
    if held is not None and held.num_rows:
        yield links(held)


def _rows(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat).view(kind).reshape(len(column), -1)


def spanning_links(group: np.ndarray, nodes: np.ndarray, words: np.ndarray, distances: np.ndarray,
                   max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between rows of equal `group` (sorted) that join different parts.

    Rows are compared with the row `d` places on, for all groups at once, for d = 1, 2, ...
    until no two rows so far apart share a group.
    """
    n = len(group)
    root = np.arange(n)
    found_u, found_v = [], []
    rows = np.arange(n)
    for d in range(1, n):
        rows = rows[rows + d < n]
        rows = rows[group[rows] == group[rows + d]]
        if not len(rows):
            break
        pair = rows[root[rows] != root[rows + d]]
        gap = np.abs(distances[pair] - distances[pair + d]).max(axis=1, initial=0)
        pair = pair[gap <= max_bits]  # the pivot table discards
        unlike = np.bitwise_count(words[pair] ^ words[pair + d]).sum(axis=1, dtype=np.int64)
        pair = pair[unlike <= max_bits]  # exact
        for r in pair.tolist():
            a, b = r, r + d
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                found_u.append(nodes[r])
                found_v.append(nodes[r + d])
        if len(pair):
            while not np.array_equal(up := root[root], root):
                root = up
    return np.array(found_u, dtype=np.int64), np.array(found_v, dtype=np.int64)


def _members(docs: DataFrame, id_col: str, text_col: str, words: int, max_bits: int,
             blocks: int | None, references: int) -> DataFrame:
    """(id, digest, fp, component_id, leader): a row per document; `leader` is the digest of the
    text of the row that stands for the component."""
    text = F.col(text_col)
    own = checkpointed(docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("digest"),
        fingerprint_column(text, words).alias("fp")))
    named = F.when(F.col("id").isNotNull(), F.struct("id", "digest"))
    by_print = own.groupBy("fp").agg(F.min(named).alias("first"))
    prints = checkpointed(by_print.select("fp", "first", F.monotonically_increasing_id().alias("node")))
    blocks = blocks or blocks_for(prints.count(), max_bits)
    links = fingerprint_links(prints, block_masks(blocks, max_bits), max_bits, references)
    roots = connected_components(links)
    rooted = prints.join(roots, prints["node"] == roots["vertex"], "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    classes = rooted.join(least, "root").select(
        "fp", F.col("least.id").alias("component_id"), F.col("least.digest").alias("leader"))
    return own.join(classes, "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       words: int = WORDS, max_bits: int = 4, blocks: int | None = None,
                       references: int = 16) -> DataFrame:
    """(id, fp, component_id) for every row of `docs`, whatever its other columns are called.

    The component id is the smallest id reachable over links. Rows with a null id keep it;
    their component id is the smallest other id of the component, null if there is none.
    Repeated rows repeat in the result.
    """
    members = _members(docs, id_col, text_col, words, max_bits, blocks, references)
    return members.select("id", F.col("fp")[0].alias("fp"), "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               max_bits: int = 4) -> DataFrame:
    """Keep one document of each component of `simhash_components`, with all columns.

    It is the one with the smallest id, whatever other texts repeat that id elsewhere. Rows
    with a null id are kept. Of rows that repeat an id and text one stays.
    """
    members = _members(docs, id_col, text_col, words, max_bits, None, 16)
    own, digest = _free_names(docs, "leader_id", "digest")
    leaders = members.where("id = component_id and digest = leader").select(
        F.col("id").alias(own), F.col("digest").alias(digest)).distinct()
    named = docs.withColumn(digest, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    met = (named[id_col] == leaders[own]) & (named[digest] == leaders[digest])
    kept = named.join(leaders, met, "left_semi").dropDuplicates([id_col, digest]).drop(digest)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))


def _free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names that `df` doesn't have."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name in taken:
            name += "_"
        found.append(name)
    return found
