"""Quality rules with thresholds that follow the corpus.

Words are runs of characters other than ASCII white space. Every text is measured once (words,
code points in words, symbols, repeated lines, words in repeated three-word windows); what
follows works on the numbers.

1. Base rules: at least 50 words, at most half of them in repeated windows.
2. The documents that pass are counted into quantile sketches per language and source. A sketch
   is a table (bucket, n) with integer buckets of a relative width below 1/64 (`bucket`), so
   sketches merge by adding counts, in any order and with the same result.
3. A rule's bounds are the sketch's quartiles, widened by `spread` times the distance between
   them, or times the rule's `least` if they lie closer. A language and source of fewer than
   `least_docs` documents takes the bounds of the merged sketches of its language, and a small
   language those of all.
4. Documents are joined with the bounds of their language and source; those outside go.

Defined results: a null or empty text has no words and fails the base rules. A null language or
source is a value like any other. Repeated rows count as often as they are there and repeat in
the result. An empty table gives an empty result.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from laurel.llm.components import checkpointed

SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50  # base rules: words, per cent of words
BUCKET_BITS = 7  # a bucket keeps the leading bits of its values
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


@dataclasses.dataclass(frozen=True)
class Rule:
    """Per mille of `part` in `whole` and how far it may lie from the quartiles."""

    name: str
    part: str
    whole: str
    least: int  # distance of the quartiles that counts at least
    low: bool = False  # whether there is a lower bound as well

    def value(self) -> Column:
        """The per mille as a whole number; null without anything to share."""
        return F.expr(f"{self.part} * 1000 div nullif({self.whole}, 0)")


RULES = [
    Rule("word_length", "word_chars", "n_words", 200, low=True),
    Rule("symbols", "n_symbols", "n_words", 20),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 50),
    Rule("repeated_words", "n_repeat_words", "n_words", 50),
]


def repeated_words(words: Sequence[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
    # Pairs are numbered anew, so the codes of three words stay below 2^63.
    _, pairs = np.unique(ids[:-1] * len(numbers) + ids[1:], return_inverse=True)
    _, windows, counts = np.unique(
        pairs[:-1] * len(numbers) + ids[2:], return_inverse=True, return_counts=True)
    again = counts[windows] > 1
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(3):
        covered[k:len(ids) - 2 + k] |= again
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """MEASURES of one UTF-8 text. Lines are separated by \\n and count if they hold a word."""
    data = text or b""
    words = data.split()  # bytes: ASCII white space only
    follow = (np.frombuffer(data, dtype=np.uint8) & 0xC0) == 0x80  # bytes inside a code point
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words), sum(map(len, words)) - int(follow.sum()),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines), len(lines) - len(set(lines)), repeated_words(words),
    )


def measures_column(text: Column | str) -> Column:
    @F.arrow_udf("struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">")
    def measured(values: pa.Array) -> pa.Array:
        rows = [measure(v.as_py()) for v in values.cast(pa.binary())]
        columns = zip(*rows) if rows else [[]] * len(MEASURES)
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=MEASURES)

    return measured(text)


def bucket(value: Column | str) -> Column:
    """Lower end of the bucket of a whole number >= 0: all but the leading bits are cleared."""
    value = F.col(value) if isinstance(value, str) else value
    shift = F.greatest(F.length(F.bin(value)) - BUCKET_BITS, F.lit(0)).cast("int")
    return F.call_function("shiftleft", F.call_function("shiftright", value, shift), shift)


def sketches(rows: DataFrame, keys: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """(keys..., measure, bucket, n): a sketch of every value per group. Nulls are left out."""
    entries = F.array(*[
        F.struct(F.lit(name).alias("measure"), bucket(value).alias("bucket"))
        for name, value in values.items()
    ])
    listed = rows.select(*keys, F.inline(entries)).where("bucket is not null")
    return listed.groupBy(*keys, "measure", "bucket").agg(F.count(F.lit(1)).alias("n"))


def merged(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sketches of coarser groups, or of several tables stacked."""
    return parts.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketch: DataFrame, keys: Sequence[str], levels: dict[str, tuple[int, int]]) -> DataFrame:
    """(keys..., measure, size, one column per level): a level is a fraction as two integers.

    The value is the bucket that holds the row of this rank, ceil(fraction * size).
    """
    group = W.partitionBy(*keys, "measure")
    ranked = sketch.withColumns({
        "upto": F.sum("n").over(group.orderBy("bucket")),
        "size": F.sum("n").over(group),
    })
    found = [
        F.min(F.when(F.col("upto") * whole >= F.col("size") * part, F.col("bucket"))).alias(name)
        for name, (part, whole) in levels.items()
    ]
    return ranked.groupBy(*keys, "measure").agg(F.max("size").alias("size"), *found)


def bounds(sketch: DataFrame, rules: Sequence[Rule], spread: int, least_docs: int,
           lang: str, source: str) -> DataFrame:
    """(lang, source, low_<rule>, high_<rule>...): a row per language and source of the sketches."""
    levels = F.array(
        F.struct(F.lit(0).alias("level"), lang, source),
        F.struct(F.lit(1).alias("level"), F.col(lang), F.lit(None).cast("string").alias(source)),
        F.struct(F.lit(2).alias("level"), F.lit(None).cast("string").alias(lang),
                 F.lit(None).cast("string").alias(source)),
    )
    keys = ["level", lang, source]
    every = merged(sketch.select(F.inline(levels), "measure", "bucket", "n"), keys)
    quarters = quantiles(every, keys, {"q1": (1, 4), "q3": (3, 4)})
    least = F.coalesce(*[F.when(F.col("measure") == r.name, F.lit(r.least)) for r in rules])
    width = spread * F.greatest(F.col("q3") - F.col("q1"), least)
    limits = quarters.withColumns({"low": F.col("q1") - width, "high": F.col("q3") + width})
    table = limits.groupBy(*keys).agg(F.max("size").alias("size"), *[
        F.max(F.when(F.col("measure") == r.name, F.col(side))).alias(f"{side}_{r.name}")
        for r in rules for side in ("low", "high")
    ])
    shown = [f"{side}_{r.name}" for r in rules for side in ("low", "high")]
    # Own bounds, those of the language and those of all, stacked beside every group.
    own = table.where("level = 0").select(lang, source, "size")
    choices = own.join(
        table.where("level = 1").select(
            F.col(lang).alias("of_lang"), F.col("size").alias("_size"), *[F.col(c).alias(f"_{c}") for c in shown]),
        F.col(lang).eqNullSafe(F.col("of_lang")), "left")
    coarse = choices.where(F.col("size") < least_docs)
    of_language = coarse.where(F.col("_size") >= least_docs).select(
        lang, source, *[F.col(f"_{c}").alias(c) for c in shown])
    everyone = table.where("level = 2").agg(F.struct(*[F.first(c).alias(c) for c in shown])).scalar()
    of_all = coarse.where(F.col("_size") < least_docs).select(
        lang, source, everyone.alias("_all")).select(lang, source, *[F.col(f"_all.{c}") for c in shown])
    large = table.where((F.col("level") == 0) & (F.col("size") >= least_docs)).select(lang, source, *shown)
    return large.unionByName(of_language).unionByName(of_all)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang: str = "lang",
           source: str = "source", rules: Sequence[Rule] = RULES, spread: int = 8,
           least_docs: int = 200) -> DataFrame:
    """(id, MEASURES..., base_failed, kept, broken): `broken` names the rules a document breaks."""
    rows = checkpointed(docs.select(
        F.col(id_col).alias("id"), F.col(lang).alias("_lang"), F.col(source).alias("_source"),
        measures_column(F.col(text_col)).alias("m"),
    ).select("id", "_lang", "_source", "m.*").withColumn("base_failed", base_failed()))
    keys = ["_lang", "_source"]
    sketch = checkpointed(sketches(
        rows.where(~F.col("base_failed")), keys, {r.name: r.value() for r in rules}))
    limits = bounds(sketch, rules, spread, least_docs, *keys).withColumnsRenamed(
        {"_lang": "_l", "_source": "_s"})
    met = F.col("_lang").eqNullSafe(F.col("_l")) & F.col("_source").eqNullSafe(F.col("_s"))
    broken = [
        F.when(r.value() > F.col(f"high_{r.name}"), r.name).when(
            F.lit(r.low) & (r.value() < F.col(f"low_{r.name}")), r.name)
        for r in rules
    ]
    found = rows.join(limits, met, "left").withColumn(
        "broken", F.when(~F.col("base_failed"), F.concat_ws(",", *broken)).otherwise(""))
    return found.select(
        "id", *MEASURES, "base_failed",
        (~F.col("base_failed") & (F.col("broken") == "")).alias("kept"), "broken",
    )


def filtered(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The documents that `judged` keeps, with all columns.

    Verdicts are joined by id, so rows that share an id stay together if any of them is kept.
    """
    kept = judged(docs, id_col, **options).where("kept").select(F.col("id").alias("kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["kept_id"]), "left_semi")
