"""Ranked lexical search against plain scoring of every document."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from laurel.llm import lexical_search as S

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_search(docs, items, k):
    bags = [(i, plain_terms(t)) for i, t in docs]
    bags = [(i, len(w), Counter(w)) for i, w in bags if w]
    total, words = len(bags), sum(n for _, n, _ in bags)
    df = Counter(t for _, _, bag in bags for t in bag)
    wanted = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(plain_terms(text))
    rows = []
    for item, own in wanted.items():
        scored = []
        for i, n, bag in bags:
            m = 100 - 90 + (90 * n * total) // words
            score = sum(
                math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10 ** 9 * bag[t]) // (1000 * bag[t] + 8 * m))
                for t in own if t in bag)
            if score > 0:
                scored.append((-score, i is None, i))
        rows += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(rows, key=str)


def test_terms_equal_the_pattern():
    rng = random.Random(1)
    letters = list("aZ09 _-.,\n{}éÀ中\x7f@[`") + [" ", "\U0001F600"]
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        assert [t.decode() for t in S.terms(text.encode())] == plain_terms(text)
    assert S.terms(None) == S.terms(b"") == []


def corpus(rng, n):
    words = [f"w{k}" for k in range(60)] + ["Été", "ÀB", "x9"]
    docs = [(k, " ".join(rng.choice(words[:rng.choice([5, 63])]) for _ in range(rng.randrange(25)))) for k in range(n)]
    copy = docs[3][1] + " w1 w2"
    docs += [(n + k, copy) for k in range(n // 3)]  # a group of copies: one class
    docs += [(2 * n + k, "w1 w2, W1! other" + str(k)) for k in range(40)]  # one bag, different texts
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 12)))) for k in range(12)]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"block_terms": 15}, {"k": 3, "block_terms": 30}])
def test_search_equals_plain_scoring(spark, options, monkeypatch):
    rng = random.Random(7)
    docs, items = corpus(rng, 150)
    docs += [(None, "w1 w2 w3"), (None, "w1 w2 w3"), (5, docs[5][1]), (900, None), (901, ""), (902, "... !!")]
    items += [(0, "w7 w8"), (None, "w1"), (50, None), (51, "?"), (52, "missing words only")]
    documents = spark.createDataFrame(
        [(*d, 3, "bag", 1) for d in docs], "doc_id long, text string, n int, bag string, item_id int").repartition(7)
    wanted = spark.createDataFrame([(*i, 9) for i in items], "item_id long, text string, doc_id int")
    found = S.search(documents, wanted, **options)
    assert found.columns == ["item_id", "rank", "id", "score"]
    rows = sorted(((r.item_id, r["rank"], r.id, r.score) for r in found.collect()), key=str)
    assert rows == plain_search(docs, items, options.get("k", 10)) and len(rows) > 30


def test_small_cells_change_nothing(spark, monkeypatch):
    """Tasks that score a few rows at a time find the same."""
    rng = random.Random(9)
    docs, items = corpus(rng, 60)
    vocabulary = {t.encode(): p for p, t in enumerate(sorted({t for _, x in items for t in plain_terms(x)}))}
    import numpy as np
    import pyarrow as pa
    pairs = [(p, vocabulary[t.encode()]) for p, (_, x) in enumerate(items) for t in set(plain_terms(x))]
    postings = S.Postings(*(np.array(c) for c in zip(*pairs)), np.arange(5, 5 + len(vocabulary)), len(items))
    bags = [S.bag(t.encode(), vocabulary)[1] for _, t in docs]
    batch = pa.RecordBatch.from_arrays(
        [pa.array(bags, pa.binary()), pa.array([20] * len(docs), pa.int64()), pa.array([[d] for d, _ in docs])],
        ["bag", "m", "members"])
    results = []
    for cells in (1, 50, 1 << 22):
        monkeypatch.setattr(S, "CELLS", cells)
        parts = [batch.slice(a, 17) for a in range(0, len(docs), 17)]
        (found,) = S.best_classes(iter(parts), postings, 4, pa.list_(pa.int64()))
        results.append(sorted(map(str, found.to_pylist())))
    assert results[0] == results[1] == results[2] and len(results[0]) > 20


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "one two")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "two")], "item_id long, text string")
    assert S.search(docs.limit(0), items).collect() == []
    assert S.search(docs, items.limit(0)).collect() == []
    assert [r["rank"] for r in S.search(docs, items).collect()] == [1]
