"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's features are its distinct words and the
beginnings of its longer words, so unseen endings of a learned stem still count:

    p(s) = (sigmoid(b + sum of w) - sigmoid(b)) / (1 - sigmoid(b)),   w >= 0,

so a sentence without telling features has probability zero and length alone says nothing.
A document combines its sentences by noisy-or with a small leak,

    P = 1 - (1 - leak) * product of (1 - p(s)),

and the weights are learned from document labels alone (cross entropy, proximal steps that
keep most weights at zero). The same weights then locate the offending sentences.

Training reads at most `per_label` documents of each label of at most `max_chars`
characters, chosen by a hash of the id. Scoring reads whole texts. Defined results: null
and empty texts score the leak; without training rows of both labels every text does.
"""

from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SENTENCE_END = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")


SPANS = "array<struct<start: int, end: int, score: double>>"
SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
STEMS = (4, 5, 6, 7)  # lengths of word beginnings that are features
MEMO_WORDS = 1 << 17  # words with a known weight per worker; forgotten when there are more


def features(words: set[str]) -> set[str]:
    """Words, and word beginnings marked by a trailing hyphen."""
    return words | {w[:k] + "-" for w in words for k in STEMS if len(w) > k}


def sentence_words(text: str | None) -> Iterator[tuple[int, int, set[str]]]:
    """Start, end and distinct lower-case words of every sentence with a word."""
    at, text = 0, text or ""
    for stop in SENTENCE_END.finditer(text):
        words = set(WORD.findall(text[at:stop.start()].lower()))
        if words:
            yield at, stop.end(), words
        at = stop.end()
    words = set(WORD.findall(text[at:].lower()))
    if words:
        yield at, len(text), words


@dataclasses.dataclass
class ToxicityModel:
    weights: dict[str, float]  # telling features only
    bias: float = -4.0
    leak: float = 0.01

    def __post_init__(self):
        self.memo: dict[str, float] = {}

    def _weight(self, word: str) -> float:
        """Weight of a word's own features, remembered within a bound."""
        if len(self.memo) >= MEMO_WORDS:
            self.memo.clear()
        known = self.weights.keys() & features({word})
        self.memo[word] = weight = sum([self.weights[f] for f in known])
        return weight

    def sentence_score(self, words: set[str]) -> float:
        """Probability of one sentence. A stem that several words share counts once."""
        memo = self.memo
        told = {w for w in words if (memo[w] if w in memo else self._weight(w))}
        if not told:
            return 0.0
        total = sum([self.weights[f] for f in sorted(self.weights.keys() & features(told))])
        base = 1 / (1 + math.exp(-self.bias))
        return (1 / (1 + math.exp(-self.bias - total)) - base) / (1 - base)

    def score(self, text: str | None) -> float:
        """Noisy-or over all sentences of a whole text."""
        clean = 1 - self.leak
        for sentence in SENTENCE_END.split((text or "").lower()):
            clean *= 1 - self.sentence_score(set(WORD.findall(sentence)))
        return 1 - clean

    def spans(self, text: str | None, threshold: float) -> list[dict]:
        """Offending sentences as character spans with their score."""
        found = ((a, b, self.sentence_score(words)) for a, b, words in sentence_words(text))
        return [{"start": a, "end": b, "score": p} for a, b, p in found if p >= threshold]

    def judge(self, text: str | None, threshold: float) -> dict:
        """Score and offending sentences in one reading."""
        clean, spans = 1 - self.leak, []
        for a, b, words in sentence_words(text):
            p = self.sentence_score(words)
            clean *= 1 - p
            if p >= threshold:
                spans.append({"start": a, "end": b, "score": p})
        return {"score": 1 - clean, "spans": spans}

    def judge_column(self, text: Column | str, threshold: float = 0.5) -> Column:
        @F.arrow_udf(f"struct<score: double, spans: {SPANS}>")
        def judged(values: pa.Array) -> pa.Array:
            kind = pa.struct([("score", pa.float64()), ("spans", SPAN_TYPE)])
            return pa.array([self.judge(v.as_py(), threshold) for v in values], type=kind)

        return judged(text)

    def score_column(self, text: Column | str) -> Column:
        @F.arrow_udf("double")
        def score(values: pa.Array) -> pa.Array:
            return pa.array((self.score(v.as_py()) for v in values), type=pa.float64())

        return score(text)

    def spans_column(self, text: Column | str, threshold: float = 0.5) -> Column:
        @F.arrow_udf(SPANS)
        def spans(values: pa.Array) -> pa.Array:
            return pa.array([self.spans(v.as_py(), threshold) for v in values], type=SPAN_TYPE)

        return spans(text)


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 20_000,
                    id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic") -> DataFrame:
    """(id, text, label) of at most `per_label` labelled ids of each label, by a hash of the id."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"))
    order = [F.xxhash64("id"), F.col("id")]
    chosen = None
    for label in (0, 1):
        some = known.where((F.col("label") == label) & F.col("id").isNotNull()).distinct()
        some = some.orderBy(*order).limit(per_label)
        chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.where(F.length("text") <= max_chars).join(F.broadcast(chosen), "id")


def train(rows: list[tuple[str, int]], bias: float = -4.0, leak: float = 0.01, rate: float = 0.2,
          rounds: int = 260, sparsity: float = 2e-5, min_documents: int = 5,
          min_share: float = 0.01, min_lift: float = 3.0) -> ToxicityModel:
    """Weights from (text, label) rows, which must be few enough for one process.

    Features can have a weight if they are in `min_documents` and a `min_share` of the toxic
    documents, and `min_lift` times as frequent there as in the others.
    """
    labels = np.array([label for _, label in rows], dtype=np.float64)
    if not len(labels) or labels.min() == labels.max():
        return ToxicityModel({}, bias, leak)
    seen, clean_seen = Counter(), Counter()
    for text, label in rows:
        if label:
            seen.update(set().union(*(features(w) for _, _, w in sentence_words(text))))
    toxic_bags = int(labels.sum())
    least = max(min_documents, min_share * toxic_bags)
    seen = {w: n for w, n in seen.items() if n >= least}  # few, and all that is kept of the texts
    number = {w: k for k, w in enumerate(sorted(seen))}
    of_sentence, word, of_bag = [], [], []
    for k, (text, label) in enumerate(rows):
        in_bag = set()
        for _, _, words in sentence_words(text):
            told = [number[w] for w in features(words) & number.keys()]
            if told:
                in_bag.update(told)
                word.extend(told)
                of_sentence.extend([len(of_bag)] * len(told))
                of_bag.append(k)
        if not label:
            clean_seen.update(in_bag)
    lift = min_lift * toxic_bags / (len(rows) - toxic_bags)
    of_sentence, word, of_bag = (np.array(x, dtype=np.int64) for x in (of_sentence, word, of_bag))
    telling = np.array([n >= lift * clean_seen[number[w]] for w, n in sorted(seen.items())], dtype=bool)
    words = [w for w, tells in zip(sorted(seen), telling) if tells]
    kept = telling[word]
    of_sentence, word = of_sentence[kept], (np.cumsum(telling) - 1)[word[kept]]
    n, m = len(labels), len(of_bag)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (n - labels.sum()))
    base = 1 / (1 + math.exp(-bias))
    weights = np.zeros(len(words))
    slope, square = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, rounds + 1):
        raw = 1 / (1 + np.exp(-bias - np.bincount(of_sentence, weights[word], m)))
        p = np.clip((raw - base) / (1 - base), 0, 1 - 1e-9)
        clean = (1 - leak) * np.exp(np.bincount(of_bag, np.log1p(-p), n))
        toxic = np.maximum(1 - clean, 1e-9)
        by_bag = share * np.where(labels == 1, -clean / toxic, 1.0)
        by_sentence = by_bag[of_bag] / (1 - p) * raw * (1 - raw) / (1 - base)
        gradient = np.bincount(word, by_sentence[of_sentence], len(words))
        slope = 0.9 * slope + 0.1 * gradient
        square = 0.99 * square + 0.01 * gradient ** 2
        pace = rate / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        weights = np.maximum(weights - pace * (slope / (1 - 0.9 ** step) + sparsity), 0)
    return ToxicityModel({w: float(x) for w, x in zip(words, weights) if x > 1e-2}, bias, leak)


def fit(docs: DataFrame, labels: DataFrame, per_label: int = 3000, max_chars: int = 20_000,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """Learn from a bounded sample of `labels` joined with `docs`."""
    sample = training_sample(docs, labels, per_label, max_chars, id_col, text_col, label_col)
    rows = sample.select("text", "label").toArrow()
    return train(list(zip(rows["text"].to_pylist(), rows["label"].to_pylist())))
