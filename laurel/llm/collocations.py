"""Phrases whose words keep together, mined after Toivonen.

A-Z are lower-cased. Texts are split at `SEPARATORS` into pieces and pieces at spaces and tabs into
words; a phrase is two or three words in a row within a piece. Everything is counted per language.

A phrase can only be frequent if its parts are, so what may be frequent follows from what is:

1. A sample of the documents proposes words and pairs, those frequent in it at a lowered limit.
2. One pass over all documents counts the proposals and their negative border exactly: all words,
   pairs of two proposed words, and phrases of two proposed pairs.
3. A word or pair that turns out frequent without having been proposed is a failure of the border.
   Another pass then takes the words and pairs known as frequent for the proposals and counts what
   they admit and no earlier pass has counted. Its border is wider: a pair that this pass is the
   first to count may be frequent, so phrases of three words are counted over such pairs too. The
   first pass has counted all words, so this closes the border.

The sample changes only which pass counts a phrase, never the result. Proposals reach the tasks as
bit tables of a fixed size (`BitTable`). A table may admit too much, which costs counts but changes no
result: whether an earlier pass has counted a phrase goes by the same tables.

Defined results: a null language is `und`; null and empty texts have no words; repeated rows count
as often as they are there. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed

SEPARATORS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
STOP = b"."  # stands between pieces; no word can hold it
_SPLIT = bytes(STOP[0] if b in SEPARATORS else b for b in range(256))
CHUNK = 8 << 20  # bytes of text counted together
EMITTED = 100_000  # rows of a batch
COUNTS = "lang string, size int, phrase string, n long"


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, with STOP between pieces."""
    return text.lower().translate(_SPLIT).replace(STOP, b" . ").split()


def word_hashes(lang: str, words: list[bytes]) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang.encode())
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w, seed) for w in words), dtype=np.uint64, count=len(words))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    z = (left ^ right >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15) + right
    z = (z ^ z >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return z ^ z >> np.uint64(32)


@dataclasses.dataclass(frozen=True)
class BitTable:
    """A set of hashes of which the leading `width` bits are kept: 2^width bits, whatever is in it."""

    width: int
    bits: np.ndarray

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.width)
        return (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

    def beyond(self, other: BitTable) -> bool:
        """Whether it holds a bit that the other one doesn't."""
        return bool((self.bits & ~other.bits).any())

    @staticmethod
    def of(phrases: DataFrame, width: int) -> BitTable:
        """Table of the words or pairs in (lang, phrase), put together by Spark."""
        @F.arrow_udf("bigint")
        def places(langs: pa.Array, values: pa.Array) -> pa.Array:
            found = np.empty(len(values), dtype=np.uint64)
            for k, (lang, value) in enumerate(zip(langs.to_pylist(), values.to_pylist())):
                hashes = word_hashes(lang, value.encode().split(b" "))
                found[k] = hashes[0] if len(hashes) == 1 else pair_hashes(hashes[:1], hashes[1:])[0]
            return pa.array((found >> np.uint64(64 - width)).astype(np.int64) + 1)

        place = phrases.select(places("lang", "phrase").alias("place"))
        # Bitmap buckets start at 1 and hold 2^15 places each, the first at place 1.
        bucket, at = F.bitmap_bucket_number("place"), F.bitmap_bit_position("place")
        parts = place.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(at).alias("bits"))
        bits = np.zeros(max(1, 2 ** width // 8), dtype=np.uint8)
        for number, part in parts.collect():  # 2^width bits in all
            start = (number - 1) * 4096
            part = np.frombuffer(part, dtype=np.uint8)[:len(bits) - start]
            bits[start:start + len(part)] = part
        return BitTable(width, bits)


@dataclasses.dataclass(frozen=True)
class Pass:
    """What one reading of the documents counts.

    Words, if it is the `first`. Pairs of words in `words` (any, if None) that are not both in
    `words_before`. Phrases of three words whose two pairs are in `pairs` (none, if None) and not both
    in `pairs_before`; after the first pass the pairs that are counted now stand beside `pairs`.
    """

    first: bool
    words: BitTable | None
    pairs: BitTable | None = None
    words_before: BitTable | None = None
    pairs_before: BitTable | None = None


class _Numbers(dict):
    """Numbers words in the order they come; STOP is 0."""

    def __init__(self) -> None:
        super().__init__({STOP: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _both(table: BitTable, hashes: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    known = table.has(hashes)
    return known[left] & known[right]


Counted = tuple[int, pa.Array, np.ndarray]


def count_chunk(lang: str, texts: list[bytes], step: Pass) -> Iterator[Counted]:
    """(size, phrases, counts) of the texts, with size 0 for the number of words."""
    numbers = _Numbers()
    words = tokens(STOP.join(texts))
    ids = np.fromiter(map(numbers.__getitem__, words), dtype=np.int64, count=len(words))
    del words
    base = len(numbers)
    names = pa.array(list(numbers), pa.binary())
    if step.first:
        counts = np.bincount(ids, minlength=base)[1:]
        yield 0, pa.array([b""]), np.array([counts.sum()])
        yield 1, names[1:], counts
    hashes = word_hashes(lang, list(numbers))

    def phrases(*parts: np.ndarray) -> pa.Array:
        return pc.binary_join_element_wise(*[names.take(pa.array(p)) for p in parts], b" ")

    left, right = ids[:-1], ids[1:]
    inside = (left > 0) & (right > 0)
    wanted = inside if step.words is None else inside & _both(step.words, hashes, left, right)
    if step.words_before is not None:
        wanted &= ~_both(step.words_before, hashes, left, right)
    codes, counts = np.unique((left * base + right)[wanted], return_counts=True)
    yield 2, phrases(codes // base, codes % base), counts
    if step.pairs is not None and len(ids) > 2:
        own = pair_hashes(hashes[left], hashes[right])
        known = step.pairs.has(own) & inside
        if not step.first:
            known |= wanted
        both = known[:-1] & known[1:]
        if step.pairs_before is not None:
            earlier = step.pairs_before.has(own)
            both &= ~(earlier[:-1] & earlier[1:])
        at = np.flatnonzero(both)
        pairs, number = np.unique(ids[at] * base + ids[at + 1], return_inverse=True)
        codes, counts = np.unique(number * base + ids[at + 2], return_counts=True)
        pair = pairs[codes // base]
        yield 3, phrases(pair // base, pair % base, codes % base), counts


def _counted(batches: Iterator[pa.RecordBatch], step: Pass) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[bytes]] = {}
    size = 0

    def emptied() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            for words, phrases, counts in count_chunk(lang, texts, step):
                for a in range(0, len(phrases), EMITTED):
                    some = phrases.slice(a, EMITTED).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([
                        pa.repeat(lang, len(some)), pa.repeat(pa.scalar(words, pa.int32()), len(some)), some,
                        pa.array(counts[a:a + EMITTED].astype(np.int64)),
                    ], ["lang", "size", "phrase", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist()):
            held.setdefault(lang, []).append(text)
            size += len(text)
            if size >= CHUNK:
                yield from emptied()
                size = 0
    yield from emptied()


def counted(texts: DataFrame, step: Pass, least: int) -> DataFrame:
    """(lang, size, phrase, n): the phrases of a pass that occur `least` times, and with size 0 the
    number of words per language."""
    shared = texts.sparkSession.sparkContext.broadcast(step)
    rows = texts.mapInArrow(lambda batches: _counted(batches, shared.value), COUNTS)
    sums = rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))
    return checkpointed(sums.where((F.col("n") >= least) | (F.col("size") == 0)))


def _of_size(counts: DataFrame, size: int) -> DataFrame:
    return counts.where(F.col("size") == size).select("lang", "phrase")


def frequent_phrases(texts: DataFrame, least: int = 10, share: float = 0.1, lowered: float = 0.5,
                     width: int = 26) -> tuple[DataFrame, int]:
    """(lang, size, phrase, n) of all phrases of up to three words that occur `least` times, and how
    many passes over all documents it took.

    `texts` has lang and text without nulls. The sample takes a `share` of the documents by a hash and
    proposes what it holds at least `lowered` * share * least times, twice at least.
    """
    chosen = F.pmod(F.xxhash64("lang", "text"), F.lit(1_000_000)) < int(share * 1_000_000)
    limit = max(2, math.ceil(lowered * share * least))
    sample = counted(texts.where(chosen), Pass(True, None), limit)
    words, pairs = (BitTable.of(_of_size(sample, size), width) for size in (1, 2))
    known = counted(texts, Pass(True, words, pairs), least)
    all_words, all_pairs = (BitTable.of(_of_size(known, size), width) for size in (1, 2))
    if not all_words.beyond(words) and not all_pairs.beyond(pairs):
        return known, 1
    # All frequent words are known by now, so this pass counts every pair that can be frequent and
    # hasn't been counted, and it admits all of them to longer phrases: nothing is left to fail.
    more = counted(texts, Pass(False, all_words, all_pairs, words, pairs), least)
    return known.unionByName(more), 2


def collocations(counts: DataFrame, inside: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score): the frequent phrases of two and three words.

    A phrase's score is that of its weakest cut into two parts; of equal cuts the first one counts.
    Phrases go that a longer one holds with at least `inside` per cent of their occurrences.
    """
    phrases = counts.where("size between 2 and 3").select(
        "lang", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    size = F.size("w")
    cuts = phrases.select(
        "lang", "phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("cut"), "w",
    ).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("first"),
             part(F.col("cut") + 1, size - F.col("cut")).alias("rest"))
    parts = counts.where("size between 1 and 2").select("lang", "phrase", "n")
    beside = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")),
                       ["lang", "first"])
    beside = beside.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")),
                         ["lang", "rest"])
    # Decimals: a product of two counts and a million may pass 64 bits.
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) "
                   "div (cast(l as decimal(18,0)) * cast(r as decimal(18,0)))")
    weakest = beside.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("weakest"))
    longer = phrases.where(size == 3).select(
        "lang", F.col("a").alias("longer"),
        F.explode(F.array(part(F.lit(1), F.lit(2)), part(F.lit(2), F.lit(2)))).alias("phrase"))
    most = longer.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    kept = weakest.join(most, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    return kept.select("lang", "phrase", "a", "weakest.l", "weakest.r", "weakest.score")


def mine(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 10,
         inside: int = 50, first: int | None = 2000, **sampling) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `first` phrases per language (all, if None), by
    falling score and count, then by the phrase."""
    lang: Column = F.coalesce(F.col(lang_col), F.lit(UNKNOWN))
    texts = docs.where(F.col(text_col) != "").select(lang.alias("lang"), F.col(text_col).alias("text"))
    counts, _ = frequent_phrases(texts, least, **sampling)
    totals = counts.where("size = 0").select(F.col("lang").alias("_lang"), F.col("n"))
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(counts, inside).withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    beside = ranked.join(totals, F.col("lang") == F.col("_lang"))
    return beside.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
