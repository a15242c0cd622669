"""Hierarchical packing of documents into training sequences.

Every document is encoded, closed with `end_id` and cut into whole windows of the longest
tier; the rest is a piece that is routed to the shortest tier that holds it. Tiers are
packed from the longest pieces down: a piece opens a sequence of its tier, the gap behind it
takes the largest shorter pieces that fit, and what then remains is filled by cutting the
shortest piece that is left. All sequences come out full; only the last ones of a partition
lack pieces, and they are cut at powers of two, which need no padding either.

Sequences are dealt to step groups of about `step_tokens` tokens, the costliest first and
always to the group with the least work, where work counts tokens and squared lengths.

A partition packs its own documents in windows of bounded size, so nothing is shuffled and
a lost executor repeats only its partitions. Sequence ids hold the partition number.

Texts are split at the tokenizer's added tokens first, as its own library does: a marker in a text
becomes the marker's id and what stands around it is encoded apart.

Defined results: a null or empty text is one piece that holds `end_id` alone; repeated rows
are packed as often as they occur; null ids are kept.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laurel.llm import bpe

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
TIERS = (256, 512, 1024, 2048)
END_ID = 1
WINDOW_TOKENS = 1 << 19
PARTITION_STRIDE = 1 << 33  # sequence numbers of one partition stay below

Piece = tuple[int, int, int]  # document number, start, length


class Packer:
    """Packs the pieces of one partition; documents are known by number."""

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tiers
        self.lengths: list[int] = []  # ascending, with `pieces` in the same order
        self.pieces: list[Piece] = []

    def add(self, document: int, length: int) -> list[list[Piece]]:
        """Whole windows of a document at once; the rest waits for `packed`."""
        longest = self.tiers[-1]
        windows = [[(document, at, longest)] for at in range(0, length - longest + 1, longest)]
        if length % longest:
            self._keep((document, length - length % longest, length % longest))
        return windows

    def _keep(self, piece: Piece) -> None:
        at = bisect.bisect_right(self.lengths, piece[2])
        self.lengths.insert(at, piece[2])
        self.pieces.insert(at, piece)

    def _take(self, at: int) -> Piece:
        del self.lengths[at]
        return self.pieces.pop(at)

    def packed(self, last: bool = False) -> Iterator[list[Piece]]:
        """Full sequences; with `last` also what does not fill one, cut at powers of two."""
        while self.pieces:
            first = self._take(-1)
            tier = next(t for t in self.tiers if first[2] <= t)
            sequence, gap = [first], tier - first[2]
            while gap and self.pieces:
                fits = bisect.bisect_right(self.lengths, gap) - 1
                piece = self._take(max(fits, 0))
                document, start, length = piece
                if length > gap:
                    self._keep((document, start + gap, length - gap))
                    piece = (document, start, gap)
                sequence.append(piece)
                gap -= piece[2]
            if not gap:
                yield sequence
            elif last:
                yield from _powers_of_two(sequence)
            else:
                for piece in sequence:
                    self._keep(piece)
                return


def _powers_of_two(sequence: list[Piece]) -> Iterator[list[Piece]]:
    rest = sum(p[2] for p in sequence)
    pieces = list(reversed(sequence))
    while rest:
        room = size = 1 << (rest.bit_length() - 1)
        cut: list[Piece] = []
        while room:
            document, start, length = pieces.pop()
            if length > room:
                pieces.append((document, start + room, length - room))
                length = room
            cut.append((document, start, length))
            room -= length
        yield cut
        rest -= size


def balanced_groups(sequences: list[list[Piece]], step_tokens: int, longest: int) -> list[int]:
    """Step group of each sequence."""
    if not sequences:
        return []
    tokens = [sum(p[2] for p in s) for s in sequences]
    work = [t + sum(p[2] ** 2 for p in s) / longest for t, s in zip(tokens, sequences)]
    heap = [(0.0, g) for g in range(-(-sum(tokens) // step_tokens))]
    groups = [0] * len(sequences)
    for k in sorted(range(len(sequences)), key=lambda k: -work[k]):
        load, g = heapq.heappop(heap)
        groups[k] = g
        heapq.heappush(heap, (load + work[k], g))
    return groups


def added_tokens(path: str = TOKENIZER) -> dict[str, bytes]:
    """Packed id of every token that a tokenizer file adds to its vocabulary."""
    with open(path, encoding="utf-8") as file:
        listed = json.load(file)["added_tokens"]
    for token in listed:
        if token["single_word"] or token["lstrip"] or token["rstrip"] or token["normalized"]:
            raise ValueError(f"added token {token['content']!r} is matched in a way that is not supported")
    return {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in listed}


def encoded(codec: bpe.Codec, texts: Iterable[str | None], added: dict[str, bytes]) -> Iterator[bytes]:
    """Packed ids of each text, with the added tokens in it."""
    if not added:
        yield from codec.encode(texts)
        return
    split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split
    parts = [split(t) if t and any(a in t for a in added) else [t] for t in texts]
    plain = codec.encode(p for own in parts for p in own[::2])  # the tokens stand in between
    for own in parts:
        yield b"".join(added[p] if k % 2 else next(plain) for k, p in enumerate(own))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, step_tokens: int = 1 << 15,
         path: str = bpe.RANKS, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: the document's id, `start` and `length` in its ids, `ids` (packed
    little-endian 32-bit), `doc_tokens`, `sequence_id`, `offset` there, `tier` (tokens of the
    sequence) and `step_group`. `tiers` ascend; each is a power of two.
    """
    added = added_tokens(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = (f"`{id_col}` {kind}, start long, length long, ids binary, doc_tokens long, "
              "sequence_id long, offset long, tier int, step_group long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, packer = bpe.codec(path), Packer(tiers)
        ending = np.array([end_id], dtype="<u4").tobytes()
        known: dict[int, tuple[object, bytes]] = {}  # documents with pieces still to place
        state = {"document": 0, "sequence": 0, "group": 0, "base": 0}

        def rows(sequences: list[list[Piece]], id_type: pa.DataType) -> pa.RecordBatch:
            groups = balanced_groups(sequences, step_tokens, tiers[-1])
            columns: list[list] = [[] for _ in range(9)]
            for sequence, group in zip(sequences, groups):
                number, offset = state["base"] + state["sequence"], 0
                state["sequence"] += 1
                total = sum(p[2] for p in sequence)
                for document, start, length in sequence:
                    own, ids = known[document]
                    for column, value in zip(columns, (
                            own, start, length, ids[4 * start:4 * (start + length)], len(ids) // 4,
                            number, offset, total, state["base"] + state["group"] + group)):
                        column.append(value)
                    offset += length
            state["group"] += max(groups, default=-1) + 1
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
                     pa.int32(), pa.int64()]
            names = [id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tier",
                     "step_group"]
            waiting = {p[0] for p in packer.pieces}
            for document in [d for d in known if d not in waiting]:
                del known[document]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, kinds)], names)

        id_type = None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.schema.field(1).type
            state["base"] = batch[0][0].as_py() * PARTITION_STRIDE
            ready: list[list[Piece]] = []
            tokens = 0
            for own, ids in zip(batch[1].to_pylist(), encoded(codec, batch[2].to_pylist(), added)):
                ids += ending
                known[state["document"]] = (own, ids)
                ready += packer.add(state["document"], len(ids) // 4)
                state["document"] += 1
                tokens += len(ids) // 4
                if tokens >= WINDOW_TOKENS:
                    ready += packer.packed()
                    yield rows(ready, id_type)
                    ready, tokens = [], 0
            ready += packer.packed()
            yield rows(ready, id_type)
        if id_type is not None:
            yield rows(list(packer.packed(last=True)), id_type)

    chosen = docs.select(
        F.spark_partition_id().alias("partition"), F.col(id_col).alias("own"), F.col(text_col).alias("text"))
    return chosen.mapInArrow(run, schema)
