"""Collocation mining against plain counting, whatever the sample proposes."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from laurel.llm import collocations as C


def pieces(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def plain(docs, least, first=2000):
    counts, totals = {}, Counter()
    for lang, text in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for words in pieces(text):
            totals["und" if lang is None else lang] += len(words)
            for size in (1, 2, 3):
                own.update(tuple(words[i:i + size]) for i in range(len(words) - size + 1))
    rows = []
    for lang, own in counts.items():
        candidates = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and p in [q[i:i + len(p)] for i in range(len(q) - len(p) + 1)]
                   for q, b in candidates.items()):
                continue
            score, k = min((10 ** 6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first]):
            rows.append((lang, rank + 1, phrase.decode(), -a, left, right, totals[lang], -score))
    return sorted(rows)


def corpus(rng, n):
    words = [f"w{k}" for k in range(12)] + ["É", "é"]
    fixed = ["red hot iron", "cold Sea", "w1 w2", "new york city"]
    docs = []
    for _ in range(n):
        parts = [rng.choice(words) if rng.random() < 0.8 else rng.choice(fixed) for _ in range(rng.randrange(40))]
        text = "".join(p + rng.choice([" ", " ", "\t", "  ", ", ", ".", "\n", "\r\n"]) for p in parts)
        docs.append((rng.choice(["en", "en", "fr", None, ""]), text))
    return docs + [("en", "the same text again and again, the same text")] * (n // 3)


@pytest.mark.parametrize("options", [
    {}, {"share": 0.0}, {"share": 1.0}, {"share": 0.05, "width": 6}, {"share": 0.5, "lowered": 2.0, "width": 12}, {"share": 0.3, "width": 16}])
def test_mining_equals_plain_counting(spark, options, monkeypatch):
    rng = random.Random(21)
    docs = corpus(rng, 150) + [("en", None), (None, None), ("de", ""), ("de", ". , ;"), ("en", "w3 " * 4000)]
    frame = spark.createDataFrame([(*d, "p", 1, 2) for d in docs], "lang string, text string, phrase string, n int, rank int")
    found = C.mine(frame.repartition(6), least=5, first=50, **options).collect()
    assert sorted(map(tuple, found)) == plain(docs, 5, 50)
    assert len(found) > 40


def test_border_failures_are_expanded(spark):
    """A sample that proposes nothing leaves all pairs and longer phrases to the expansion pass."""
    rng = random.Random(22)
    docs = [r for r in corpus(rng, 100) if r[0] == "en"]
    texts = spark.createDataFrame(docs, "lang string, text string")
    full, once = C.frequent_phrases(texts, 5, share=1.0, lowered=1.0)
    late, passes = C.frequent_phrases(texts, 5, share=0.0)
    assert once == 1 and passes == 2
    assert sorted(map(tuple, full.collect())) == sorted(map(tuple, late.collect()))


def test_small_chunks_change_nothing():
    docs = [t.encode() for lang, t in corpus(random.Random(23), 60) if lang == "en"]
    step = C.Pass(True, None)

    def total(chunks):
        counts = Counter()
        for chunk in chunks:
            for size, phrases, n in C.count_chunk("en", chunk, step):
                for p, x in zip(phrases.to_pylist(), n):
                    counts[size, p] += int(x)
        return counts

    assert total([docs]) == total([[d] for d in docs])


def test_products_beyond_64_bits(spark):
    big = 4 * 10 ** 12
    rows = [("x", 1, "a", big + 7), ("x", 1, "b", big + 11), ("x", 2, "a b", big), ("x", 0, "", 2 * big)]
    (r,) = C.collocations(spark.createDataFrame(rows, C.COUNTS)).collect()
    assert r.score == 10 ** 6 * big * big // ((big + 7) * (big + 11)) and (r.a, r.l, r.r) == (big, big + 7, big + 11)


def test_empty_tables(spark):
    docs = spark.createDataFrame([("en", "too few words")], "lang string, text string")
    assert C.mine(docs).collect() == []
    assert C.mine(docs.limit(0)).collect() == []
