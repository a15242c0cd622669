"""Registered queries on whole small tables, and the pipeline's stages."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from checks.compare import _rows, connect
from laurel.llm import bpe, langid, simhash, toxicity
from laurel.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(SQL))
def test_query_equals_sql(spark, connection, name):
    ours = QUERIES[name](spark, FOLDER)
    answer = connection.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(ours.columns) == sorted(names)
    assert _rows(ours.columns, ours.collect()) == _rows(names, answer.fetchall())


def test_native_plan_has_no_python(spark):
    for name in ("op1_url_filter", "op9_warc_derivatives"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_held_out_queries(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = QUERIES["op8_language_id"](spark, FOLDER).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(found) == docs.count()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 4 == 2 for d in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    found = QUERIES["op2_toxicity"](spark, FOLDER).join(labels, "doc_id", "left").toPandas()
    assert len(found) == docs.count()
    assert (found.held_out == [zlib.crc32(str(d).encode()) % 3 == 1 for d in found.doc_id]).all()
    held = found[found.held_out & found.toxic.notna()]
    assert (held.predicted == held.toxic).mean() > 0.9 and held.score.between(0, 1).all()


def fold(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_toxicity_query_equals_a_plain_noisy_or(spark):
    """Scores of whole texts from the learned weights, sentence by sentence."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    model = toxicity.fit(docs, labels.where(F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1")))
    assert len(model.weights) > 5

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    def sentences(text):
        return [(m.start(), m.end(), set(re.findall(r"\w+", m.group().lower())))
                for m in re.finditer(r"[^.!?\n]+", text)]

    def chance(words):
        told = {x for w in words for x in (w, *(w[:k] + "-" for k in (4, 5, 6, 7) if len(w) > k)) if x in model.weights}
        base = sigmoid(-4.0)
        return (sigmoid(-4.0 + sum(model.weights[x] for x in told)) - base) / (1 - base)

    found = {r.doc_id: r for r in QUERIES["op2_toxicity"](spark, FOLDER).collect()}
    seen = 0
    for r in docs.collect():
        parts = [(a, b, chance(words)) for a, b, words in sentences(r.text) if words]
        score = 1 - 0.99 * math.prod(1 - p for _, _, p in parts)
        own = found[r.doc_id]
        assert own.score == pytest.approx(score, abs=1e-9) and own.predicted == int(own.score >= 0.7)
        bad = [(a, b) for a, b, p in parts if p >= 0.5]
        spans = [tuple(map(int, x.split("-"))) for x in own.offending.split(";") if x]
        # A located sentence starts behind the stop before it and includes its own stop.
        assert len(spans) == own.n_offending == len(bad)
        assert all(x <= a and b <= y for (a, b), (x, y) in zip(bad, spans))
        seen += len(bad)
    assert seen > 10


def test_language_query_equals_a_plain_naive_bayes(spark):
    """A dictionary of n-gram buckets, one text at a time; the learned counts from the same rows."""
    docs = [r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]

    def grams(text):
        letters = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text.lower())
        letters = re.sub(" +", " ", letters).removeprefix(" ")
        out = []
        for size in (1, 2, 3):
            for at in range(len(letters) - size + 1):
                mixed = size
                for k, c in enumerate(letters[at:at + size]):
                    mixed = (mixed ^ ord(c)) * langid.MIXERS[k] % 2 ** 32
                    mixed ^= mixed >> 15
                out.append((mixed * 0x9E3779B1 % 2 ** 32) >> 18)
        return out

    # No language has more rows than the bound on learning rows, so all of them are learned from.
    counts, kept = {}, {}
    for r in docs:
        kept[r.doc_id] = grams(r.text)
        if fold(r.doc_id, 4) != 2 and r.lang is not None:
            counts.setdefault(r.lang, Counter()).update(kept[r.doc_id])
    totals = {x: sum(c.values()) + 0.5 * langid.BUCKETS for x, c in counts.items()}
    found = {r.doc_id: r for r in QUERIES["op8_language_id"](spark, FOLDER).collect()}
    for r in docs:
        own = kept[r.doc_id]
        share = min(len(own), 200) / len(own)
        level = {x: share * sum(math.log((c[g] + 0.5) / totals[x]) for g in own) for x, c in counts.items()}
        best = max(sorted(level), key=level.get)
        score = 1 / sum(math.exp(v - level[best]) for v in level.values())
        assert found[r.doc_id].lang_pred == best and found[r.doc_id].score == pytest.approx(score, rel=1e-6)


def test_packing_and_encoding_queries_equal_the_libraries(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in docs.items()}
    pieces = QUERIES["op3_packing"](spark, FOLDER).collect()
    by_doc, by_sequence = {}, {}
    for r in pieces:
        own = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        by_doc.setdefault(r.doc_id, []).append((r.start, r.length))
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places, ends in [(by_doc, {d: len(x) for d, x in ids.items()}), (by_sequence, None)]:
        for key, parts in places.items():
            parts.sort()
            assert [a for a, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1].tolist()]
            total = sum(n for _, n in parts)
            assert total == ends[key] if ends else total <= 2048 and total & (total - 1) == 0
    assert set(by_doc) == set(ids)
    lines = open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    lengths = Counter()
    for r in QUERIES["op5_byte_bpe"](spark, FOLDER).collect():
        own = coder.encode_ordinary(docs[r.doc_id] or "")
        lengths[len(own)] += 1
        assert (r.n_tokens, r.ids_sha256) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((docs[r.doc_id] or "").encode()).hexdigest()
    assert {r.length: r.documents for r in QUERIES["op7_token_counts"](spark, FOLDER).collect()} == lengths


def test_simhash_query_equals_brute_force(spark):
    found = QUERIES["op4_simhash"](spark, FOLDER).toPandas()
    bits = np.array([int(x, 16) for x in found.fingerprint], dtype=np.uint64)
    root = found.doc_id.to_numpy().copy()
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    while True:
        least = np.array([root[row].min() for row in near])
        if (least == root).all():
            break
        root = least
    assert (found.component_id == root).all()


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = docs.limit(1).select(
        F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("long").alias("n_chars"))
    for rows in (docs.unionByName(odd).unionByName(odd), docs.limit(0)):
        everything = set(map(tuple, rows.collect()))
        for name, stage in corpus_pipeline.STAGES[:-1]:
            left = stage(spark, rows, FOLDER)
            assert left.columns == docs.columns
            assert set(map(tuple, left.collect())) <= everything
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, FOLDER)
    toxic = docs.join(clean, "doc_id", "left_anti").join(
        spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").toPandas()
    assert len(toxic) and (toxic.toxic == 1).mean() > 0.7
    lettered = docs.limit(5).unionByName(odd.withColumn("text", F.lit("123 --- 5")))
    assert stages["language"](spark, lettered, FOLDER).count() == 5


def test_pipeline_equals_brute_force(spark):
    """All rows of `run` from stage decisions made one document at a time."""
    result = corpus_pipeline.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, stages["toxicity"](spark, docs, FOLDER), FOLDER).toPandas()
    bits = np.array([simhash.fingerprint(t) for t in kept.text]).view(np.uint64)
    root = kept.doc_id.to_numpy().copy()
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 4
    while True:
        least = np.array([root[row].min() for row in near])
        if (least == root).all():
            break
        root = least
    left = kept[kept.doc_id == root]
    pieces = result.toPandas()
    assert set(pieces.doc_id) == set(left.doc_id) and len(left) < len(kept)
    texts = dict(zip(left.doc_id, left.text))
    for doc, own in pieces.groupby("doc_id"):
        ids = b"".join(own.sort_values("start").ids)
        assert ids == next(bpe.codec().encode([texts[doc]])) + np.array([1], "<u4").tobytes()
