"""Operator 3: byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression runs. Code points map to classes through one table; a class is a function from states to states
of an automaton that splits words, numbers, other signs, white space and the contractions 's 't 're 've 'm 'll 'd.
The functions' closure under composition is a small monoid with a product table, so the states at all positions come
from an associative scan: blocks are folded side by side, the blocks' totals are scanned, and the blocks run again
from their first states. Slices between boundaries are hashed; distinct slices look their ids up in a cache, and the
missing ones are merged together, one merge of every slice at a time, by pair rank. The ids are decoded and compared with
the bytes; slices that share a hash with others show there and are merged by themselves. Tokens keep the byte offset at
which they start.

Cases: a null text has null ids; an empty text has none; very long slices (runs of one class) are merged by a heap in
O(n log n); ill-formed UTF-8 is encoded bytewise and round-trips; repeated rows get equal ids; an empty table gives no
rows; ids of documents that are no number become null; other columns are not looked at.
"""

from __future__ import annotations

import base64
import functools
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, slices, span_hashes, utf8

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  # default of the setting spark.vignette.vocabulary; read by the driver alone
CACHE = 1_000_000  # distinct slices that a worker remembers
WIDE = 48  # longer slices go through the heap

# --- automaton ------------------------------------------------------------------------------------------------------

LETTER, NUMBER, OTHER, SHORT, LONG, BLANK, LAST, SPACE, END = range(9)
# SHORT, LONG: an apostrophe that a contraction of 2 or 3 characters may start; BLANK: white space that more of it (or
# the end) follows; LAST: the last white space before something else; SPACE: the same, if it is ' '; END: between texts
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_BLANK, AFTER_SPACE, TWO_LEFT, ONE_LEFT = range(8)


def _step(state: int, sign: int) -> tuple[int, bool]:
    """(next state, whether a slice starts here)."""
    if sign == END:
        return FRESH, True
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if sign in (BLANK, LAST, SPACE):
        if sign == BLANK:
            return IN_BLANK, state != IN_BLANK
        return (AFTER_SPACE if sign == SPACE else FRESH), True
    joins = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS}.get(sign, IN_OTHER)
    if state in (joins, AFTER_SPACE):
        return joins, False
    if sign == SHORT:
        return ONE_LEFT, True
    if sign == LONG:
        return TWO_LEFT, True
    return joins, True


@functools.lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, image of FRESH under each element, boundary[state, class])."""
    gen = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    known = {g: i for i, g in enumerate(dict.fromkeys(gen))}
    todo = list(known)
    while todo:
        f = todo.pop()
        for g in gen:
            h = tuple(g[s] for s in f)
            if h not in known:
                known[h] = len(known)
                todo.append(h)
    every = sorted(known, key=known.get)
    table = np.array([[known[tuple(g[s] for s in f)] for g in every] for f in every], np.uint8 if len(every) <= 256 else np.uint16)
    return np.array([known[g] for g in gen], table.dtype), table, np.array([f[FRESH] for f in every], np.uint8), np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])


def _states(signs: np.ndarray, block: int = 512) -> np.ndarray:
    """State before each sign: a blocked scan over the monoid."""
    element, product, image, _ = _monoid()
    n = len(signs)
    columns = max(1, -(-n // block))
    grid = np.full(columns * block, END, np.uint8)
    grid[:n] = signs
    steps = element[grid].reshape(columns, block).T.copy()  # one row per place in a block
    size = product.shape[1]
    flat = product.ravel()
    total = steps[0].astype(np.intp)
    for k in range(1, block):
        total = flat[total * size + steps[k]].astype(np.intp)
    shift = 1
    while shift < columns:  # inclusive scan of the blocks' totals
        total = np.concatenate([total[:shift], flat[total[:-shift] * size + total[shift:]]])
        shift *= 2
    state = np.concatenate([[FRESH], image[total[:-1]]]).astype(np.intp)
    move = np.array([[_step(s, c)[0] for c in range(9)] for s in range(8)], np.uint8).ravel()
    rows = grid.reshape(columns, block).T.copy()
    out = np.empty((block, columns), np.uint8)
    for k in range(block):
        out[k] = state
        state = move[state * 9 + rows[k]].astype(np.intp)
    return out.T.ravel()[:n]


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kind = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        major = unicodedata.category(chr(c))[0]
        if major == "L":
            kind[c] = LETTER
        elif major == "N":
            kind[c] = NUMBER
    kind[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return kind


def code_points(raw: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Code point at each head byte; ill-formed sequences give some sign of class OTHER."""
    lead = raw[heads].astype(np.int64)
    wide = lead >= 0xC0
    if not wide.any():
        return np.where(lead < 0x80, lead, 0xFFFD)
    padded = np.concatenate([raw, np.zeros(3, np.uint8)]).astype(np.int64) & 0x3F
    out = lead.copy()
    for low, high, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0xF8, 0x07, 3)):
        at = np.flatnonzero((lead >= low) & (lead < high))
        value = lead[at] & bits
        for k in range(1, more + 1):
            value = value << 6 | padded[heads[at] + k]
        out[at] = value
    out[(lead >= 0xF8) | ((lead >= 0x80) & (lead < 0xC0)) | (out > 0x10FFFF)] = 0xFFFD
    return out


def boundaries(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which slices start, over all rows."""
    if not len(raw):
        return np.empty(0, np.int64)
    head = (raw & 0xC0) != 0x80
    starts = offsets[:-1][np.diff(offsets) > 0]
    head[starts] = True
    heads = np.flatnonzero(head)
    point = code_points(raw, heads)
    sign = _classes()[point]
    first = np.searchsorted(heads, starts)  # texts' first characters
    ends = np.append(first[1:], len(heads))
    last = np.zeros(len(heads), bool)
    last[ends - 1] = True
    blank = sign == BLANK
    more = np.zeros(len(heads), bool)
    more[:-1] = blank[1:]
    final = blank & ~more & ~last
    sign[final] = np.where(point[final] == 32, SPACE, LAST)
    marks = np.flatnonzero(point == 39)
    if len(marks):
        room = np.searchsorted(ends, marks, side="right")
        left = ends[room] - marks
        padded = np.concatenate([point, [0, 0]])
        a, b = padded[marks + 1], padded[marks + 2]
        one = (left > 1) & np.isin(a, [ord(c) for c in "stmd"])
        two = (left > 2) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        sign[marks[one]] = SHORT
        sign[marks[two]] = LONG
    spread = np.insert(sign, first, END)  # an END before every text resets the automaton
    state = _states(spread)
    state = np.delete(state, first + np.arange(len(first)))
    return heads[_monoid()[3][state, sign]]


# --- merges ---------------------------------------------------------------------------------------------------------


class Known:
    """Slices by hash, sorted, and their ids."""

    def __init__(self, names: np.ndarray = np.empty(0, np.uint64), starts: np.ndarray = np.zeros(1, np.int64), ids: np.ndarray = np.empty(0, np.int32)):
        self.names, self.starts, self.ids = names, starts, ids

    def places(self, names: np.ndarray) -> np.ndarray:
        """Where each name stands, -1 where it does not."""
        if not len(self.names):
            return np.full(len(names), -1)
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        return np.where(self.names[at] == names, at, -1)

    def with_more(self, other: Known) -> Known:
        every = np.concatenate([self.names, other.names])
        n = np.concatenate([np.diff(self.starts), np.diff(other.starts)])
        first = np.concatenate([self.starts[:-1], len(self.ids) + other.starts[:-1]])
        order = np.argsort(every, kind="stable")
        n, first = n[order], first[order]
        until = np.cumsum(n)
        pool = np.concatenate([self.ids, other.ids])
        return Known(every[order], np.concatenate([[0], until]), pool[np.repeat(first - (until - n), n) + np.arange(until[-1] if len(until) else 0)])


class Vocabulary:
    def __init__(self, data: bytes):
        """data: lines of a token in base 64 and its rank."""
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}
        size = max(self.ranks.values()) + 1
        self.bytes: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            self.bytes[rank] = token
        self.length = np.array([len(t) for t in self.bytes], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.raw = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.pairs = pairs
        # open addressing, looked up with vectors
        self.bits = 20
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        self.far = 1
        for (a, b), rank in pairs.items():
            key, probe = a << 20 | b, 0
            at = self._slot(np.array([key]))[0]
            while self.keys[at] >= 0:
                at, probe = (at + 1) & ((1 << self.bits) - 1), probe + 1
            self.keys[at], self.values[at] = key, rank
            self.far = max(self.far, probe + 1)
        self.forget()

    def forget(self) -> None:
        self.known, self.recent = Known(), Known()

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the merged pair, or a large number."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        out = np.full(len(key), 1 << 30, np.int32)
        open_ = np.flatnonzero((a >= 0) & (b >= 0))
        for _ in range(self.far):
            here = self.keys[at[open_]]
            hit = here == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (here >= 0)]
            if not len(open_):
                break
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_long(self, piece: bytes) -> list[int]:
        ids = [int(self.single[b]) for b in piece]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        heap = [(self.pairs[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or self.pairs.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (p := self.pairs.get((ids[i], ids[after[i]]))) is not None:
                    heapq.heappush(heap, (p, i))
            if before[i] >= 0 and (p := self.pairs.get((ids[before[i]], ids[i]))) is not None:
                heapq.heappush(heap, (p, before[i]))
        return [i for i in ids if i >= 0]

    def merge(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slices one after the other, number of ids of each)."""
        size = end - start
        count = np.zeros(len(size), np.int64)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        groups = [(1, 1), (2, 4), (5, 8), (9, 14), (15, 24), (25, WIDE)]
        for low, high in groups:
            rows = np.flatnonzero((size >= low) & (size <= high))
            for a in range(0, len(rows), 50_000):
                part = rows[a : a + 50_000]
                ids = self._merge_rows(raw, start[part], size[part], high)
                real = ids >= 0
                count[part] = real.sum(axis=1)
                kept.append((part, ids[real]))
        for i in np.flatnonzero(size > WIDE):
            ids = np.array(self.merge_long(raw[start[i] : end[i]].tobytes()), np.int64)
            count[i] = len(ids)
            kept.append((np.array([i]), ids))
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.empty(at[-1], np.int32)
        for part, ids in kept:
            n = count[part]
            out[np.repeat(at[part] - (np.cumsum(n) - n), n) + np.arange(len(ids))] = ids
        return out, count

    def _merge_rows(self, raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
        at = start[:, None] + np.arange(width)
        ids = np.where(np.arange(width) < size[:, None], self.single[raw[np.minimum(at, len(raw) - 1)]], -1)
        if width == 1:
            return ids
        rank = self.rank_of(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        out, live = np.full_like(ids, -1), np.arange(len(ids))
        places = np.arange(width)
        while len(live):
            best = rank.argmin(axis=1)
            low = rank[np.arange(len(live)), best]
            done = low >= 1 << 30
            if done.any():
                out[live[done]] = ids[done]
                live, ids, rank, best, low = live[~done], ids[~done], rank[~done], best[~done], low[~done]
                if not len(live):
                    break
            moved = np.concatenate([ids[:, 1:], np.full((len(ids), 1), -1)], axis=1)
            ids = np.where(places > best[:, None], moved, ids)
            r = np.arange(len(ids))
            ids[r, best] = low
            shifted = np.concatenate([rank[:, 1:], np.full((len(ids), 1), 1 << 30, rank.dtype)], axis=1)
            rank = np.where(places[:-1] > best[:, None], shifted, rank)
            after = np.minimum(best + 1, width - 1)
            rank[r[best < width - 1], best[best < width - 1]] = self.rank_of(ids[r, best], np.where(best + 1 < width, ids[r, after], -1))[best < width - 1]
            left = np.flatnonzero(best > 0)
            rank[left, best[left] - 1] = self.rank_of(ids[left, best[left] - 1], ids[left, best[left]])
        return out

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, where each row's ids begin and end)."""
        start = boundaries(raw, offsets)
        if not len(start):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        end = np.append(start[1:], len(raw))
        name = span_hashes(raw, start, end)
        distinct, place, which = np.unique(name, return_index=True, return_inverse=True)
        have, n, first, base = np.zeros(len(distinct), bool), np.empty(len(distinct), np.int64), np.empty(len(distinct), np.int64), 0
        for known in (self.known, self.recent):
            at = known.places(distinct)
            hit = np.flatnonzero((at >= 0) & ~have)
            n[hit] = known.starts[at[hit] + 1] - known.starts[at[hit]]
            first[hit] = base + known.starts[at[hit]]
            have[hit] = True
            base += len(known.ids)
        new = np.flatnonzero(~have)
        fresh, count = self.merge(raw, start[place[new]], end[place[new]])
        n[new] = count
        first[new] = base + np.cumsum(count) - count
        pool = np.concatenate([self.known.ids, self.recent.ids, fresh])
        per = n[which]
        until = np.cumsum(per)
        ids = pool[np.repeat(first[which] - (until - per), per) + np.arange(until[-1])]
        while len(bad := self._wrong(ids, until - per, raw, start, end)):  # two slices share a hash: these are merged by themselves
            fixed, n_fixed = self.merge(raw, start[bad], end[bad])
            pieces = np.split(ids, until[:-1])
            for i, piece in zip(bad.tolist(), np.split(fixed, np.cumsum(n_fixed)[:-1])):
                pieces[i] = piece
            ids, per[bad] = np.concatenate(pieces), n_fixed
            until = np.cumsum(per)
        row_first = np.searchsorted(start, offsets)
        bounds = np.concatenate([[0], until])[row_first]
        if len(new):
            self._remember(distinct[new], fresh, count)
        return ids, bounds

    def _wrong(self, ids: np.ndarray, first: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The slices whose ids do not decode to their bytes; those of another length first."""
        bad = np.flatnonzero(np.add.reduceat(self.length[ids], first) != end - start)
        if not len(bad):
            differ = np.flatnonzero(self.decode(ids) != raw)
            bad = np.unique(np.searchsorted(start, differ, side="right") - 1)
        return bad

    def _remember(self, name: np.ndarray, ids: np.ndarray, count: np.ndarray) -> None:
        """New slices go into a small table, which is merged into the large one when it has grown to a share of it."""
        if len(self.known.names) + len(self.recent.names) + len(name) > CACHE:
            self.forget()
        self.recent = self.recent.with_more(Known(name, np.concatenate([[0], np.cumsum(count)]), ids))
        if len(self.recent.names) > max(20_000, len(self.known.names) // 2):
            self.known, self.recent = self.known.with_more(self.recent), Known()

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        n = self.length[ids]
        until = np.cumsum(n)
        return self.raw[np.repeat(self.start[ids] - (until - n), n) + np.arange(until[-1] if len(until) else 0)]


@functools.lru_cache(maxsize=2)
def _loaded(data: bytes) -> Vocabulary:
    """One a process."""
    return Vocabulary(data)


@functools.lru_cache(maxsize=4)
def read(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return _loaded(read(path))


def chosen(spark, path: str | None) -> bytes:
    """The vocabulary's file (some 1 MB), which goes along with the tasks: `path`, else what the session names."""
    return read(path or spark.conf.get("spark.vignette.vocabulary", VOCABULARY))


ENCODED = "doc_id bigint, ids array<int>, offsets array<int>, roundtrip boolean"


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, offsets, roundtrip) of every row: token ids, the byte at which each token starts, and whether
    decoding gave the text back. No shuffle."""

    data = chosen(docs.sparkSession, path)

    def run(batches):
        words = _loaded(data)
        for batch in batches:
            raw_all, offsets_all = utf8(batch.column(1))
            for a, b in slices(offsets_all, 1 << 20):
                raw, offsets = raw_all[offsets_all[a] : offsets_all[b]], offsets_all[a : b + 1] - offsets_all[a]
                ids, bounds = words.encode(raw, offsets)
                n = words.length[ids]
                until = np.cumsum(n)
                row = np.repeat(np.arange(b - a), np.diff(bounds))
                begin = (until - n - offsets[row]).astype(np.int32)
                edge = np.concatenate([[0], until])[bounds]
                same = np.diff(edge) == np.diff(offsets)
                if not same.all() or not np.array_equal(words.decode(ids), raw):
                    back = words.decode(ids)
                    same = np.array([np.array_equal(back[edge[i] : edge[i + 1]], raw[offsets[i] : offsets[i + 1]]) for i in range(b - a)])
                gone = pa.array(batch.column(1).slice(a, b - a).is_null())
                lists = [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(x)) for x in (ids, begin)]
                null = pa.scalar(None, pa.list_(pa.int32()))
                lists = [pa.compute.if_else(gone, null, x) if batch.column(1).null_count else x for x in lists]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists, pa.array(same)], ["doc_id", "ids", "offsets", "roundtrip"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, ENCODED)


def counts(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, total) of every row: the number of token ids of its whole text, 0 for a null. No shuffle."""

    data = chosen(docs.sparkSession, path)

    def run(batches):
        words = _loaded(data)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                _, bounds = words.encode(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(bounds), pa.int64())], ["doc_id", "total"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, total bigint")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give a null text."""

    data = chosen(encoded.sparkSession, path)

    def run(batches):
        words = _loaded(data)
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            size = np.array([0 if x is None else x for x in pa.compute.list_value_length(lists).to_pylist()], np.int64)
            edge = np.concatenate([[0], np.cumsum(words.length[flat])])[np.concatenate([[0], np.cumsum(size)])]
            made = words.decode(flat).tobytes()
            texts = [None if gone else made[a:b].decode(errors="replace") for a, b, gone in zip(edge[:-1], edge[1:], lists.is_null().to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("bigint"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id bigint, text string")
