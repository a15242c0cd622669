"""Byte-level BPE encoding and decoding without regular expressions.

Pre-tokenisation is a scan. Every code point gets a symbol from its class and, for white
space and apostrophes, from its neighbours (`_symbols`). A symbol is a transition function
of a small automaton; composing functions is associative, so a text is cut into equal
blocks whose prefix compositions are computed for all blocks at once, and the blocks are
then chained by their totals (`_boundaries`). The functions reachable by composition form
a finite monoid, which is numbered once: a composition is one table lookup.

The slices between boundaries are encoded by pair merging with a bounded cache. Token ids
are held as little-endian unsigned 32-bit integers in one binary value per text, which
Spark can digest and slice without Python.

The byte offsets of the slices are retained (`encode_with_offsets_column`): a token's place in its
text is the offset of its slice and the width of the tokens before it there. Decoding copies
token bytes to these places, for whole arrays of tokens at once and for any run of tokens alone.

Defined results: a null or empty text has no ids and decodes to empty bytes. Texts are
encoded whole; special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import Column
from pyspark.sql import functions as F

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

CHARS_PER_SCAN = 1 << 19  # texts are scanned together up to so many characters
TOKENS_PER_COPY = 1 << 17  # tokens that are decoded together

# Code points that are letters or numbers for the rank files' splitter and
# unassigned in this Python's Unicode tables (first, last, class).
LATER_UNICODE = [
    (0x1C89, 0x1C8A, "L"), (0xA7CB, 0xA7CD, "L"), (0xA7DA, 0xA7DC, "L"), (0x105C0, 0x105F3, "L"),
    (0x10D40, 0x10D49, "N"), (0x10D4A, 0x10D65, "L"), (0x10D6F, 0x10D85, "L"),
    (0x10EC2, 0x10EC4, "L"), (0x11380, 0x11389, "L"), (0x1138B, 0x1138B, "L"),
    (0x1138E, 0x1138E, "L"), (0x11390, 0x113B5, "L"), (0x113B7, 0x113B7, "L"),
    (0x113D1, 0x113D1, "L"), (0x113D3, 0x113D3, "L"), (0x116D0, 0x116E3, "N"),
    (0x11BC0, 0x11BE0, "L"), (0x11BF0, 0x11BF9, "N"), (0x13460, 0x143FA, "L"),
    (0x16100, 0x1611D, "L"), (0x16130, 0x16139, "N"), (0x16D40, 0x16D6C, "L"),
    (0x16D70, 0x16D79, "N"), (0x18CFF, 0x18CFF, "L"), (0x1CCF0, 0x1CCF9, "N"),
    (0x1E5D0, 0x1E5ED, "L"), (0x1E5F0, 0x1E5F0, "L"), (0x1E5F1, 0x1E5FA, "N"),
]

# Classes of a code point.
OTHER, LETTER, NUMBER, SPACE, BLANK, APOSTROPHE = range(6)  # BLANK is U+0020

# Symbols. WHITE: white space that is followed by white space or the end. LAST_BLANK and
# LAST_SPACE: the last white space before something else. SHORT and LONG: an apostrophe
# that opens a contraction of one or two letters if a slice starts there.
S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_LAST_BLANK, S_LAST_SPACE, S_SHORT, S_LONG = range(8)
SYMBOLS = 8

# States: what the slice that holds the last code point is.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_BLANK, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8

SHORT_ENDINGS = "stmd"  # fixed values
LONG_ENDINGS = ("re", "ve", "ll")  # fixed values


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a slice starts at this code point."""
    if symbol == S_LETTER:
        if state == TWO_MORE:
            return ONE_MORE, False
        if state == ONE_MORE:
            return CLOSED, False
        return IN_LETTERS, state not in (IN_LETTERS, AFTER_BLANK)
    if symbol == S_NUMBER:
        return IN_NUMBERS, state not in (IN_NUMBERS, AFTER_BLANK)
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol == S_LAST_BLANK:
        return AFTER_BLANK, True
    if symbol == S_LAST_SPACE:
        return CLOSED, True
    if state in (IN_OTHER, AFTER_BLANK):
        return IN_OTHER, False
    return {S_OTHER: IN_OTHER, S_SHORT: ONE_MORE, S_LONG: TWO_MORE}[symbol], True


@functools.cache
def _automaton() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Composition table, functions as rows of next states, and slice starts by (state, symbol).

    Function numbers 0..7 are the symbols, 8..15 the same symbols at the start of a text
    (constant functions), the rest arise by composition.
    """
    rows = [tuple(_step(s, x)[0] for s in range(STATES)) for x in range(SYMBOLS)]
    rows += [(_step(CLOSED, x)[0],) * STATES for x in range(SYMBOLS)]
    number: dict[tuple[int, ...], int] = {}
    for k, row in enumerate(rows):
        number.setdefault(row, k)
    generators = list(rows)
    todo = 0
    while todo < len(rows):
        for g in generators:
            made = tuple(g[s] for s in rows[todo])
            if made not in number:
                number[made] = len(rows)
                rows.append(made)
        todo += 1
    size = len(rows)
    compose = np.zeros((size, 2 * SYMBOLS), dtype=np.uint8)
    for a in range(size):
        for x in range(2 * SYMBOLS):
            compose[a, x] = number[tuple(rows[x][s] for s in rows[a])]
    starts = np.zeros((STATES, 2 * SYMBOLS), dtype=bool)
    for s in range(STATES):
        for x in range(SYMBOLS):
            starts[s, x] = _step(s, x)[1]
    starts[:, SYMBOLS:] = True
    return compose.ravel(), np.array(rows, dtype=np.uint8).ravel(), starts.ravel()


@functools.cache
def _classes() -> np.ndarray:
    """Class of every code point."""
    kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
    table = np.fromiter(
        (kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)),
        dtype=np.uint8, count=0x110000,
    )
    table[[9, 10, 11, 12, 13, 0x85]] = SPACE
    table[0x20], table[0x27] = BLANK, APOSTROPHE
    for first, last, kind in LATER_UNICODE:
        table[first:last + 1] = kinds[kind]
    return table


def _symbols(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Function number of every code point; `firsts` are the places where texts start."""
    classes = _classes()[points]
    n = len(points)
    begins = np.zeros(n + 1, dtype=bool)
    begins[firsts] = True
    begins[n] = True
    symbols = np.array([S_OTHER, S_LETTER, S_NUMBER, S_WHITE, S_WHITE, S_OTHER], dtype=np.uint8)[classes]
    white = np.flatnonzero((classes == SPACE) | (classes == BLANK))
    after = np.minimum(white + 1, n - 1)
    last = ~begins[white + 1] & (classes[after] != SPACE) & (classes[after] != BLANK)
    ends = white[last]
    symbols[ends] = np.where(classes[ends] == BLANK, S_LAST_BLANK, S_LAST_SPACE)
    for at in np.flatnonzero(classes == APOSTROPHE):
        if at + 1 < n and not begins[at + 1]:
            one = points[at + 1]
            if one < 128 and chr(one) in SHORT_ENDINGS:
                symbols[at] = S_SHORT
            elif at + 2 < n and not begins[at + 2] and points[at + 2] < 128 and one < 128:
                if chr(one) + chr(points[at + 2]) in LONG_ENDINGS:
                    symbols[at] = S_LONG
    symbols[firsts] += SYMBOLS
    return symbols


def _boundaries(symbols: np.ndarray) -> np.ndarray:
    """Places where slices start, by a blocked scan over transition functions."""
    compose, rows, starts = _automaton()
    n = len(symbols)
    length = max(16, int(n ** 0.5) // 2)
    blocks = -(-n // length)
    padded = np.full(blocks * length, S_OTHER, dtype=np.uint8)
    padded[:n] = symbols
    steps = np.ascontiguousarray(padded.reshape(blocks, length).T)
    prefixes = np.empty_like(steps)
    prefixes[0] = steps[0]
    for j in range(1, length):  # all blocks at once
        prefixes[j] = compose[prefixes[j - 1].astype(np.uint16) * (2 * SYMBOLS) + steps[j]]
    entry = np.empty(blocks, dtype=np.uint16)
    state = CLOSED
    for b, total in enumerate(prefixes[-1].tolist()):  # chain the blocks
        entry[b] = state
        state = rows[total * STATES + state]
    before = np.empty((length, blocks), dtype=np.uint16)
    before[0] = entry
    before[1:] = rows[prefixes[:-1].astype(np.uint16) * STATES + entry]
    hit = starts[before * (2 * SYMBOLS) + steps]
    return np.flatnonzero(hit.T.ravel()[:n])


class Merges:
    """Pair merging: always the adjacent pair of lowest rank, the leftmost first."""

    NONE = 1 << 30
    WIDTH = 15

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.keys = np.array(sorted(pairs), dtype=np.uint64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank, which is also the id, of the merged pair; NONE for a negative right id."""
        key = left.astype(np.uint64) << np.uint64(32) | np.maximum(right, 0).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0), self.values[at], self.NONE)

    def short(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many slices up to 15 bytes in a row, and how many each has."""
        n, width = len(starts), self.WIDTH
        columns = np.arange(width)
        raw = np.frombuffer(data + bytes(width), dtype=np.uint8)
        ids = np.where(columns < sizes[:, None], self.single[raw[starts[:, None] + columns]], -1)
        scores = np.full((n, width), self.NONE, dtype=np.int64)
        held = ids[:, 1:] >= 0
        scores[:, :-1][held] = self._rank(ids[:, :-1][held], ids[:, 1:][held])
        done, rows = ids.copy(), np.arange(n)
        while len(rows):
            at = scores.argmin(axis=1)
            line = np.arange(len(rows))
            best = scores[line, at]
            over = best == self.NONE
            if over.any():
                done[rows[over]] = ids[over]
                keep = ~over
                rows, ids, scores, at, best = rows[keep], ids[keep], scores[keep], at[keep], best[keep]
                line = np.arange(len(rows))
            ids[line, at] = best
            source = columns + (columns > at[:, None])
            ids = np.concatenate([ids, np.full((len(rows), 1), -1)], axis=1)[line[:, None], source]
            source = columns + (columns >= at[:, None])
            scores = np.concatenate(
                [scores, np.full((len(rows), 1), self.NONE)], axis=1)[line[:, None], source]
            follower = ids[line, np.minimum(at + 1, width - 1)]
            scores[line, at] = self._rank(best, np.where(at + 1 < width, follower, -1))
            left = np.flatnonzero(at > 0)
            scores[left, at[left] - 1] = self._rank(ids[left, at[left] - 1], best[left])
        kept = done >= 0
        return done[kept].astype(np.uint32), kept.sum(axis=1)

    def any(self, piece: bytes) -> list[int]:
        """Ids of one slice of any length."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else _merge_long(piece, self.ranks)


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """With a heap and a linked list: n log n for very long slices."""
    n = len(piece)
    end = list(range(1, n + 1))  # a part is piece[i:end[i]]
    prior = list(range(-1, n - 1))
    dead = bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        middle = end[i]
        if dead[i] or middle >= n or dead[middle] or end[middle] != stop:
            continue
        dead[middle] = 1
        end[i] = stop
        if stop < n:
            prior[stop] = i
            if (r := ranks.get(piece[i:end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if i > 0:
            left = prior[i]
            if (r := ranks.get(piece[left:stop])) is not None:
                heapq.heappush(heap, (r, left, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class _SliceCache:
    """Known ids of slices up to 15 bytes, looked up for a whole array of slices at once.

    An open-addressing table: a key is the slice's bytes in two 64-bit words with the
    length in the top byte; a value is a place and count in a pool of ids. The table is
    emptied when it is full, so its memory is bounded. Longer slices are merged anew.
    """

    SLOTS = 1 << 21
    PROBES = 16

    def __init__(self, merges: Merges):
        self.merges = merges
        cut = [(1 << (8 * min(max(n, 0), 8))) - 1 for n in range(-8, 16)]
        self.low_mask = np.array(cut[8:], dtype=np.uint64)
        self.high_mask = np.array(cut[:16], dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.low = np.zeros(self.SLOTS, dtype=np.uint64)
        self.high = np.zeros(self.SLOTS, dtype=np.uint64)  # 0: empty, as lengths are over 0
        self.place = np.zeros(self.SLOTS, dtype=np.int32)
        self.count = np.zeros(self.SLOTS, dtype=np.uint8)
        self.pool = np.zeros(1 << 16, dtype=np.uint32)
        self.used = self.entries = 0

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = low * np.uint64(0x9E3779B97F4A7C15) ^ high * np.uint64(0xC2B2AE3D27D4EB4F)
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - 21)).astype(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 if it isn't there."""
        found = np.where((self.high[slot] == high) & (self.low[slot] == low), slot, -1)
        open_ = np.flatnonzero((found < 0) & (self.high[slot] != 0))
        for _ in range(self.PROBES):
            if not len(open_):
                break
            at = (slot[open_] + 1) & (self.SLOTS - 1)
            slot[open_] = at
            held = self.high[at]
            same = (held == high[open_]) & (self.low[at] == low[open_])
            found[open_[same]] = at[same]
            open_ = open_[~same & (held != 0)]
        return found

    def _store(self, low: np.ndarray, high: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Enter distinct new keys; a key without a free slot within reach stays out."""
        places = self.used + np.cumsum(counts) - counts
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(ids)] = ids
        self.used += len(ids)
        slot, rest = self._slot(low, high), np.arange(len(low))
        for _ in range(self.PROBES):
            free = np.flatnonzero(self.high[slot[rest]] == 0)
            at, winner = np.unique(slot[rest[free]], return_index=True)
            won = rest[free[winner]]
            self.low[at], self.high[at] = low[won], high[won]
            self.place[at], self.count[at] = places[won], counts[won]
            self.entries += len(won)
            rest = np.setdiff1d(rest, won, assume_unique=True)
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & (self.SLOTS - 1)

    def ids(self, data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all slices in a row, and how many each has."""
        if self.entries > self.SLOTS // 2:
            self.clear()
        sizes = np.diff(offsets)
        words = np.empty(len(data) + 16, dtype=np.uint64)  # words[i]: the 8 bytes from i on
        padded = data + bytes(32)
        for k in range(8):
            part = np.frombuffer(padded, dtype="<u8", offset=k, count=(len(data) + 16 - k + 7) // 8)
            words[k::8] = part
        short = np.minimum(sizes, 15)
        low = words[offsets[:-1]] & self.low_mask[short]
        high = words[offsets[:-1] + 8] & self.high_mask[short] | short.astype(np.uint64) << np.uint64(56)
        found = self._find(low, high, self._slot(low, high))
        found[sizes > 15] = -1
        new = np.flatnonzero((found < 0) & (sizes <= 15))
        if len(new):
            _, first, own = np.unique(
                np.stack([low[new], high[new]], axis=1).view("V16").ravel(),
                return_index=True, return_inverse=True,
            )
            only = new[first]
            merged, counts = self.merges.short(data, offsets[only], sizes[only])
            before = self.used
            self._store(low[only], high[only], merged, counts)
            new_places = (before + np.cumsum(counts) - counts)[own]
            new_counts = counts[own]
        places, counts = self.place[found].astype(np.int64), self.count[found].astype(np.int64)
        if len(new):
            places[new], counts[new] = new_places, new_counts
        extra: list[int] = []
        for i in np.flatnonzero(sizes > 15).tolist():
            merged = self.merges.any(data[offsets[i]:offsets[i + 1]])
            places[i], counts[i] = self.used + len(extra), len(merged)
            extra.extend(merged)
        pool = np.concatenate([self.pool[:self.used], np.array(extra, dtype=np.uint32)])
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return pool[np.repeat(places - (ends - counts), counts) + np.arange(total)], counts


def _read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        pairs = (line.split() for line in lines if line.strip())
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


class Decoder:
    """The bytes of all tokens of one rank file, one after another."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.widths = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
        self.starts = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)

    def offsets(self, packed: bytes) -> np.ndarray:
        """Byte place of every token if the first one stands at 0."""
        widths = self.widths[np.frombuffer(packed, dtype="<u4")]
        return np.cumsum(widths) - widths

    def decode(self, packed: bytes, offsets: bytes | None = None) -> bytes:
        """The bytes behind a run of tokens, which stand at `offsets` (packed as the ids are)."""
        ids = np.frombuffer(packed, dtype="<u4")
        places = self.offsets(packed) if offsets is None else np.frombuffer(offsets, dtype="<u4").astype(np.int64)
        if len(places) != len(ids):
            raise ValueError("there must be an offset per token")
        found = []
        for a in range(0, len(ids), TOKENS_PER_COPY):
            own, at = ids[a:a + TOKENS_PER_COPY], places[a:a + TOKENS_PER_COPY + 1]
            widths = self.widths[own]
            if (np.diff(at) != widths[:len(at) - 1]).any():
                raise ValueError("offsets are not those of the tokens")
            copied = np.repeat(self.starts[own] - (at[:len(own)] - at[0]), widths)
            copied += np.arange(len(copied))
            found.append(self.bytes[copied].tobytes())
        return b"".join(found)


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str = RANKS):
        self.ranks = _read_ranks(path)
        self.cache = _SliceCache(Merges(self.ranks))
        self.decoder = Decoder(self.ranks)

    def _scan(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Bytes of all texts, byte offsets of all slices, and each text's first slice."""
        joined = "".join(texts)
        data = joined.encode("utf-8")
        lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        first = np.concatenate([[0], np.cumsum(lengths)])
        if not joined:
            return data, np.zeros(1, dtype=np.int64), np.zeros(len(first), dtype=np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
        cuts = _boundaries(_symbols(points, first[:-1][lengths > 0]))
        own = np.searchsorted(cuts, first)
        if len(data) == len(joined):
            offsets = cuts
        else:
            widths = np.ones(len(points), dtype=np.int64)
            for bound in (0x80, 0x800, 0x10000):
                widths += points >= bound
            offsets = (np.cumsum(widths) - widths)[cuts]
        return data, np.append(offsets, len(data)), own

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """Packed ids of each text, in order."""
        for group in _groups(texts):
            data, offsets, own = self._scan(group)
            ids, counts = self.cache.ids(data, offsets)
            ends = np.concatenate([[0], np.cumsum(counts)])[own].tolist()
            packed = ids.astype("<u4").tobytes()
            for a, b in zip(ends, ends[1:]):
                yield packed[4 * a:4 * b]

    def encode_with_offsets(self, texts: Iterable[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Packed ids of each text and the byte places of its tokens, from the offsets of the slices."""
        for group in _groups(texts):
            data, offsets, own = self._scan(group)
            ids, counts = self.cache.ids(data, offsets)
            widths = self.decoder.widths[ids]
            before = np.cumsum(widths) - widths
            first = np.cumsum(counts) - counts  # token that a slice begins with
            places = np.repeat(offsets[:-1], counts) + before - np.repeat(before[first], counts)
            ends = np.concatenate([[0], np.cumsum(counts)])[own]
            places -= np.repeat(offsets[own[:-1]], np.diff(ends))  # within the text
            packed, placed = ids.astype("<u4").tobytes(), places.astype("<u4").tobytes()
            for a, b in zip((4 * ends).tolist(), (4 * ends[1:]).tolist()):
                yield packed[a:b], placed[a:b]

    def slices_of(self, text: str) -> list[bytes]:
        """Slices of one text before merging."""
        data, offsets, _ = self._scan([text])
        places = offsets.tolist()
        return [data[a:b] for a, b in zip(places, places[1:])]


def _groups(texts: Iterable[str | None]) -> Iterator[list[str]]:
    group, size = [], 0
    for text in texts:
        text = text or ""
        if group and size + len(text) > CHARS_PER_SCAN:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


@functools.lru_cache(maxsize=2)
def codec(path: str = RANKS) -> Codec:
    """One codec and cache per worker and file."""
    return Codec(path)


@functools.lru_cache(maxsize=2)
def decoder(path: str = RANKS) -> Decoder:
    """One decoder per worker and file, without the tables of the encoder."""
    return Decoder(_read_ranks(path))


def encode_column(text: Column | str, path: str = RANKS) -> Column:
    """Packed token ids of a text column."""

    @F.arrow_udf("binary")
    def encode(values: pa.Array) -> pa.Array:
        return pa.array(codec(path).encode(v.as_py() for v in values), type=pa.binary())

    return encode(text)


def encode_with_offsets_column(text: Column | str, path: str = RANKS) -> Column:
    """Struct of `ids` and `offsets`: token ids of a text column and the tokens' byte places in it."""

    @F.arrow_udf("struct<ids: binary, offsets: binary>")
    def encode(values: pa.Array) -> pa.Array:
        pairs = list(codec(path).encode_with_offsets(v.as_py() for v in values))
        columns = [pa.array([p[k] for p in pairs], type=pa.binary()) for k in (0, 1)]
        return pa.StructArray.from_arrays(columns, names=["ids", "offsets"])

    return encode(text)


def round_trip_column(text: Column | str, path: str = RANKS) -> Column:
    """Struct of `ids` and `decoded`: token ids and the bytes they decode to by their offsets.

    One function for both: two chained columns take a second Python worker for every task.
    """

    @F.arrow_udf("struct<ids: binary, decoded: binary>")
    def round_trip(values: pa.Array) -> pa.Array:
        own = codec(path)
        pairs = [(ids, own.decoder.decode(ids, places)) for ids, places in
                 own.encode_with_offsets(v.as_py() for v in values)]
        columns = [pa.array([p[k] for p in pairs], type=pa.binary()) for k in (0, 1)]
        return pa.StructArray.from_arrays(columns, names=["ids", "decoded"])

    return round_trip(text)


def count_column(text: Column | str, path: str = RANKS) -> Column:
    """Number of tokens of a text column."""

    @F.arrow_udf("bigint")
    def count(values: pa.Array) -> pa.Array:
        return pa.array((len(ids) // 4 for ids in codec(path).encode(v.as_py() for v in values)), type=pa.int64())

    return count(text)


def decode_column(ids: Column | str, offsets: Column | str | None = None, path: str = RANKS) -> Column:
    """Bytes behind packed token ids; null ids decode to empty bytes.

    With the `offsets` of the tokens they are put there; an offset that doesn't fit is an error.
    """

    @F.arrow_udf("binary")
    def decode(values: pa.Array) -> pa.Array:
        return pa.array((decoder(path).decode(x.as_py() or b"") for x in values), type=pa.binary())

    @F.arrow_udf("binary")
    def decode_at(values: pa.Array, places: pa.Array) -> pa.Array:
        pairs = zip(values.to_pylist(), places.to_pylist())
        return pa.array((decoder(path).decode(x or b"", at or b"") for x, at in pairs), type=pa.binary())

    return decode(ids) if offsets is None else decode_at(ids, offsets)


def offsets_column(ids: Column | str, path: str = RANKS) -> Column:
    """Byte offset of every token, packed like the ids."""

    @F.arrow_udf("binary")
    def offsets(values: pa.Array) -> pa.Array:
        known = decoder(path)
        return pa.array((known.offsets(x.as_py() or b"").astype("<u4").tobytes() for x in values), type=pa.binary())

    return offsets(ids)
