"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased, every character that is not a letter becomes a blank, runs of blanks
one blank, and the n-grams of `SIZES` are hashed into `buckets`. The model is a matrix of
log-probabilities (buckets by languages), sent to the workers with the scoring function;
its size is fixed by `buckets` and the number of languages, which has a bound. Many texts are scored at once
with numpy: gather the rows of all n-grams, then sum by text.

Fitting reads about `per_language` documents of each language, chosen by a hash of the id.
Counting is done by Spark; the driver gets at most buckets times languages counts.

Defined results: a null text or one without a letter is `und` with score 0. The score is
the posterior of the predicted language with the evidence counted as at most `EVIDENCE`
n-grams, as neighbouring n-grams are far from independent. Ties go to the smaller name.
"""

from __future__ import annotations

import dataclasses
import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZES = (1, 2, 3)
BUCKETS = 1 << 14
EVIDENCE = 200
UNKNOWN = "und"
CHARS_PER_BATCH = 1 << 18
MIXERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@functools.cache
def _letters() -> np.ndarray:
    return np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)),
                       dtype=bool, count=0x110000)


def _grams(texts: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, the text of each, and which texts have a letter."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), dtype=np.int64, count=len(lowered))
    points = np.frombuffer("".join(lowered).encode("utf-32-le"), dtype="<u4")
    owner = np.repeat(np.arange(len(texts)), sizes)
    letter = _letters()[points]
    fresh = np.ones(len(points), dtype=bool)
    if len(points):
        fresh[1:] = owner[1:] != owner[:-1]
    keep = letter.copy()
    keep[1:] |= letter[:-1] & ~fresh[1:]  # the first blank after a letter
    kept = np.where(letter, points, 0x20)[keep].astype(np.uint32)
    owner = owner[keep]
    has_letter = np.bincount(owner, minlength=len(texts)) > 0
    shift = np.uint32(32 - (buckets - 1).bit_length())
    hashed, owners = [], []
    for size in SIZES:
        if len(kept) < size:
            continue
        n = len(kept) - size + 1
        mixed = np.full(n, size, dtype=np.uint32)
        for k in range(size):
            mixed = (mixed ^ kept[k:k + n]) * np.uint32(MIXERS[k])
            mixed ^= mixed >> np.uint32(15)
        whole = owner[:n] == owner[size - 1:]
        hashed.append(((mixed * np.uint32(0x9E3779B1)) >> shift)[whole])
        owners.append(owner[:n][whole])
    if not hashed:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), has_letter
    return np.concatenate(hashed), np.concatenate(owners), has_letter


def _pieces(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > CHARS_PER_BATCH:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@dataclasses.dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    log_probability: np.ndarray  # buckets x languages

    def predict(self, texts: Iterable[str | None]) -> Iterator[tuple[str, float]]:
        for group in _pieces(texts):
            if not self.languages:
                yield from ((UNKNOWN, 0.0) for _ in group)
                continue
            hashed, owner, has_letter = _grams(group, len(self.log_probability))
            amount = np.bincount(owner, minlength=len(group))
            sums = np.stack([
                np.bincount(owner, self.log_probability[:, k][hashed], len(group))
                for k in range(len(self.languages))
            ], axis=1)
            level = sums / np.maximum(amount, 1)[:, None] * np.minimum(amount, EVIDENCE)[:, None]
            best = level.argmax(axis=1)
            score = 1 / np.exp(level - level.max(axis=1, keepdims=True)).sum(axis=1)
            for k, known in enumerate(has_letter.tolist()):
                yield (self.languages[best[k]], float(score[k])) if known else (UNKNOWN, 0.0)

    def predict_column(self, text: Column | str) -> Column:
        """Struct of `language` and `score`."""

        @F.arrow_udf("struct<language: string, score: double>")
        def predict(values: pa.Array) -> pa.Array:
            rows = list(self.predict(v.as_py() for v in values))
            return pa.StructArray.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())],
                ["language", "score"],
            )

        return predict(text)


def fit(docs: DataFrame, per_language: int = 1000, buckets: int = BUCKETS, smoothing: float = 0.5,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        most_languages: int = 1000) -> LanguageModel:
    """Learn from `docs`; rows with a null id, text or language are left out.

    A row is read if a hash of its id falls below `per_language` / (rows of its language). More
    than `most_languages` languages are an error: the model would not fit into every task.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                       F.col(lang_col).alias("lang")).dropna()
    known = rows.groupBy("lang").count().limit(most_languages + 1).collect()
    if len(known) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    sizes = docs.sparkSession.createDataFrame(known, "lang string, count long")
    draw = F.shiftrightunsigned(F.xxhash64("id"), 11) / float(1 << 53)
    sample = rows.join(F.broadcast(sizes), "lang").where(draw * F.col("count") < per_language)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch["lang"].to_pylist(), batch["text"].to_pylist()
            for lang in set(langs):
                own = totals.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                for group in _pieces(t for t, x in zip(texts, langs) if x == lang):
                    own += np.bincount(_grams(group, buckets)[0], minlength=buckets)
        for lang, own in totals.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(own[at])],
                ["lang", "bucket", "n"],
            )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].to_pylist()
    languages = tuple(sorted(set(names)))
    place = {x: k for k, x in enumerate(languages)}
    counts = np.full((buckets, len(languages)), smoothing)
    counts[table["bucket"].to_numpy(), [place[x] for x in names]] += table["n"].to_numpy()
    return LanguageModel(languages, np.log(counts / counts.sum(axis=0)))
