"""Quality rules against plain counting, and the defined results of odd rows."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from laurel.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measure(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    covered = {p for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines),
            len(lines) - len(set(lines)), len(covered))


def test_measures_equal_plain_counts():
    rng = random.Random(3)
    letters = ["a", "b", " ", " ", "\n", "é", " ", "#", "|", "\r", "\x0b", "中"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [None, "", "a b c", "a b a b a", "x x x x", "a b c d a b c", "a\n\na\n a", "word " * 5000]
    for text in texts:
        assert Q.measure(text if text is None else text.encode()) == plain_measure(text), text


def quartile(values, quarter):
    return sorted(values)[-(-len(values) * quarter // 4) - 1]


def low_end(value):
    shift = max(value.bit_length() - Q.BUCKET_BITS, 0)
    return value >> shift << shift


def test_sketches_merge_and_answer_quantiles(spark):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), int(10 ** rng.uniform(0, 6)) - 1, rng.choice([None, 7])) for _ in range(3000)]
    rows += [("hot", 500, 1)] * 2000
    frame = spark.createDataFrame(rows, "g string, v long, w long")
    values = {"v": F.col("v"), "w": F.col("w")}
    whole = Q.sketches(frame, ["g"], values)
    halves = [Q.sketches(frame.where(F.xxhash64("v") % 2 == k), ["g"], values) for k in (0, 1, -1)]
    again = Q.merged(halves[0].unionByName(halves[1]).unionByName(halves[2]), ["g"])
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, again.collect()))
    found = Q.quantiles(whole, ["g"], {"q1": (1, 4), "q2": (2, 4), "q3": (3, 4)}).collect()
    assert len(found) == 6
    for r in found:
        own = [row[1 if r.measure == "v" else 2] for row in rows if row[0] == r.g]
        own = [x for x in own if x is not None]
        assert r["size"] == len(own)
        assert (r.q1, r.q2, r.q3) == tuple(low_end(quartile(own, k)) for k in (1, 2, 3))
        assert all(b <= v < b * (1 + 1 / 64) + 1 for b, v in zip((r.q1, r.q2, r.q3), (quartile(own, k) for k in (1, 2, 3))))


def sentence(rng, length, n=120):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(length + rng.randrange(3))) for _ in range(n))


def test_thresholds_follow_language_and_source(spark):
    """The same long words are usual in one source and out of bounds in another; a small source
    takes the bounds of its language, a small language those of all."""
    rng = random.Random(5)
    rows = [(k, sentence(rng, 3), "x", "short") for k in range(60)]
    rows += [(100 + k, sentence(rng, 14), "y", "long") for k in range(60)]
    rows += [(200, sentence(rng, 14), "x", "short"), (201, sentence(rng, 14), "x", "new"),
             (202, sentence(rng, 3), "x", "new"), (203, sentence(rng, 14), "y", "new"), (204, sentence(rng, 200), None, None),
             (205, "### " * 3 + sentence(rng, 3), "x", "short"), (206, sentence(rng, 3) + " #$%&" * 30, "x", "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    found = {r.id: r for r in Q.judged(docs, least_docs=30).collect()}
    assert len(found) == len(rows)
    assert all(found[k].kept for k in range(60)) and all(found[100 + k].kept for k in range(60))
    assert not found[200].kept and found[200].broken == "word_length"
    assert not found[201].kept and found[202].kept and found[203].kept
    assert found[204].broken == "word_length"
    assert found[205].kept and found[206].broken == "symbols"
    kept = Q.filtered(docs, least_docs=30)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, r in found.items() if r.kept}


def test_odd_rows(spark):
    rng = random.Random(6)
    good = sentence(rng, 4)
    rows = [(1, None, "a", "s"), (2, "", None, None), (3, good, None, "s"), (3, good, None, "s"),
            (None, good, "a", None), (4, " \n\t ", "a", "s"), (5, "same line here\n" * 100, "a", "s"),
            (6, "long " + "x" * 300_000 + " " + good, "a", "s"), (7, sentence(rng, 4, 30_000), "a", "s")]
    docs = spark.createDataFrame(
        [(*r, 1, "k", True, 5) for r in rows],
        "doc_id long, text string, lang string, source string, id int, kept string, base_failed boolean, n_words int")
    found = sorted(((r.id, r.n_words, r.base_failed, r.kept) for r in Q.judged(docs).collect()),
                   key=lambda r: (r[0] is None, r))
    assert found == [
        (1, 0, True, False), (2, 0, True, False), (3, 120, False, True), (3, 120, False, True),
        (4, 0, True, False), (5, 300, True, False), (6, 122, False, False), (7, 30_000, False, True), (None, 120, False, True)]
    assert Q.judged(docs.limit(0)).collect() == []
    assert Q.judged(docs.where("doc_id < 3")).count() == 2  # nothing to learn from
    kept = Q.filtered(docs)
    assert kept.columns == docs.columns and kept.count() == 4
