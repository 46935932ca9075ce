"""Operator 7: near-duplicate groups from 128-bit SimHash fingerprints, searched by a May-Ozerov recursion.

Features are the distinct pairs of neighbouring words (lower case, punctuation dropped; pairs of two words of up
to three bytes, which are mostly function words, only count where a text has no other). Equal fingerprints
collapse first. The search for pairs within MAX_DISTANCE bits is a recursion over lists: a node draws random
centres on its strip of a random order of the coordinates and passes on to each child the fingerprints whose
partial weight against the centre is small; small lists are compared in full; whole trees repeat with new orders
until the computed recall of a pair at MAX_DISTANCE reaches RECALL. The first levels run in the map side of one
shuffle, so that a list fits a task's memory whatever the number of fingerprints; the rest of the recursion runs
where the list arrives. A list returns a spanning forest of its pairs, not all pairs, so a group of c copies costs
c rows and not c * c; groups are the connected components of all forests.

What is grouped, kept and removed is the pair of doc_id and fingerprint, never the doc_id alone: a doc_id that comes
with several texts may be a copy with one of them and unique with another, and only the copied row goes.

Cases: a null doc_id takes no part (the row stays); a null text or one without any word belongs to no group, and
stays whatever else its doc_id holds; rows that repeat a doc_id with the same text (or with near copies of equal
fingerprint) count as copies, and the one with the least text stays; a group's leader is the smallest doc_id, of equal
ones the smaller fingerprint; a very long text is read whole; an empty table has no groups; extra columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GOLD, bounded_batches, mix, remove, slices, span_hashes, stored, utf8, words

BITS = 128
MAX_DISTANCE = 24
RECALL = 0.95
LEAF = 4096  # lists up to this length are compared in full
TASK_LIST = 1_000_000  # the expected length of a list that is sent to one task
PASS_RATE = 0.01  # the share of random fingerprints that a filter lets through
FANOUT = 8.0  # expected children of a fingerprint at each level
SEED = 20_240_917


def fingerprints(column: pa.Array, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(n, 2) uint64 fingerprints and the number of features; texts without words have 0 features."""
    raw_all, offsets = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    n = len(offsets) - 1
    out, count = np.zeros((n, 2), np.uint64), np.zeros(n, np.int64)
    for lo, hi in slices(offsets, most):
        for a in range(lo, hi, 60_000):
            b = min(hi, a + 60_000)
            _fingerprint_rows(raw_all[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], out[a:b], count[a:b])
    return out, count


def _fingerprint_rows(raw: np.ndarray, offsets: np.ndarray, out: np.ndarray, count: np.ndarray) -> None:
    starts, ends, row = words(raw, offsets)
    if not len(starts):
        return
    n, h, short = len(out), span_hashes(raw, starts, ends), ends - starts <= 3
    paired = row[1:] == row[:-1]
    telling = paired & ~(short[1:] & short[:-1])
    has = np.bincount(row[1:][telling], minlength=n) > 0
    take = np.flatnonzero(telling | (paired & ~has[row[1:]]))
    alone = np.flatnonzero(np.bincount(row, minlength=n)[row] == 1)
    feature = np.concatenate([mix(h[take] * np.uint64(3) + h[take + 1]), h[alone]])
    of = np.concatenate([row[take + 1], row[alone]]).astype(np.uint64)
    key = np.sort((of << np.uint64(48)) | (feature >> np.uint64(16)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    of, feature = (key >> np.uint64(48)).astype(np.int64), key & np.uint64((1 << 48) - 1)
    count[:] = np.bincount(of, minlength=n)
    have = np.flatnonzero(count)
    first = np.concatenate([[0], np.cumsum(count[have])[:-1]])
    for w in range(2):
        value = mix(feature + np.uint64(((w + 1) * int(GOLD)) & (2**64 - 1)))
        total = np.add.reduceat(np.unpackbits(value.view(np.uint8).reshape(-1, 8), axis=1), first, axis=0, dtype=np.int32)
        out[have, w] = np.packbits(2 * total > count[have][:, None], axis=1).view(np.uint64).ravel()


# --- the recursion's plan -------------------------------------------------------------------------------------------


@functools.lru_cache(maxsize=64)
def _rates(strip: int, distance: int) -> tuple[int, float, float]:
    """(largest weight t, share of fingerprints passing, share of those whose partner at `distance` of BITS passes too)."""
    law = [math.comb(strip, w) / 2**strip for w in range(strip + 1)]
    t = max((w for w in range(strip + 1) if sum(law[: w + 1]) <= PASS_RATE), default=0)
    if sum(law[: t + 1]) < PASS_RATE / 3:
        t += 1
    p = sum(law[: t + 1])
    both = 0.0
    for d in range(min(strip, distance) + 1):
        of_d = math.comb(distance, d) * math.comb(BITS - distance, strip - d) / math.comb(BITS, strip) if strip - d <= BITS - distance else 0
        for w in range(t + 1):  # d of the strip's bits flip, k of them among the w set ones
            both += of_d * law[w] * sum(math.comb(w, k) * math.comb(strip - w, d - k) / math.comb(strip, d) for k in range(max(0, d - strip + w), min(w, d) + 1) if w + d - 2 * k <= t)
    return t, p, both / p


def plan(n: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> dict:
    """Levels, strips, centres and repetitions for n fingerprints. Only the depth depends on n, by its logarithm."""
    depth = sent = 0
    while n * PASS_RATE**depth > LEAF:
        depth += 1
    while n * PASS_RATE**sent > TASK_LIST or (sent == 0 and depth):
        sent += 1
    strip = min(64, BITS // max(2, depth))
    t, p, q = _rates(strip, distance)
    centres = max(1, round(FANOUT / p))
    caught = 1.0
    for _ in range(depth):
        caught = 1 - math.exp(-centres * p * q * caught)
    trees = 1 if caught >= recall else math.ceil(math.log(1 - recall) / math.log(1 - caught))
    return {"depth": depth, "sent": sent, "strip": strip, "weight": t, "centres": centres, "trees": trees, "caught": caught}


@functools.lru_cache(maxsize=256)
def _level(tree: int, level: int, strip: int, centres: int) -> tuple[np.ndarray, np.ndarray]:
    """(mask of the level's strip as two words, centres on that strip)."""
    order = np.random.default_rng([SEED, tree]).permutation(BITS)
    mine = np.take(order, range(level * strip, level * strip + strip), mode="wrap")
    bits = np.zeros(BITS, np.uint8)
    bits[mine] = 1
    mask = np.packbits(bits).view(np.uint64)
    drawn = np.random.default_rng([SEED, tree, level]).integers(0, 2**64, (centres, 2), np.uint64, endpoint=False)
    return mask, drawn & mask


def _children(fp: np.ndarray, tree: int, level: int, p: dict) -> tuple[np.ndarray, np.ndarray]:
    """(row, centre) of every fingerprint and every child list that it enters."""
    mask, centres = _level(tree, level, p["strip"], p["centres"])
    rows, where = [], []
    masked = fp & mask
    for a in range(0, len(fp), 1024):
        part = masked[a : a + 1024]
        weight = np.bitwise_count(part[:, :1] ^ centres[:, 0]) + np.bitwise_count(part[:, 1:] ^ centres[:, 1])
        r, c = np.nonzero(weight <= p["weight"])
        rows.append(r + a)
        where.append(c)
    return np.concatenate(rows or [np.empty(0, np.int64)]), np.concatenate(where or [np.empty(0, np.int64)])


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of a[i] and b[i]; a component's label is its smallest row."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return label
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


def _compare(fp: np.ndarray, label: np.ndarray, rows: np.ndarray, distance: int) -> np.ndarray:
    """Joins all pairs of `rows` within the distance. Rows of one component are not compared with each other, so
    that a list of c copies of one text costs c comparisons a foreign row and not c * c."""
    left = rows
    while len(left) > 1:
        name, size = np.unique(label[left], return_counts=True)
        largest = size.argmax()
        if size[largest] >= 256:
            own = label[left] == name[largest]
            block, other = left[own], left[~own]
            left = other
        else:
            block, other = left[:256], left
            left = left[256:]
        for a in range(0, len(block), 256):
            part = block[a : a + 256]
            for b in range(0, len(other), 16384):
                against = other[b : b + 16384]
                near = (np.bitwise_count(fp[part, 0][:, None] ^ fp[against, 0]) + np.bitwise_count(fp[part, 1][:, None] ^ fp[against, 1])) <= distance
                x, y = np.nonzero(near)
                if len(x):
                    label = _merge(label, part[x], against[y])
    return label


def _recurse(fp: np.ndarray, label: np.ndarray, rows: np.ndarray, tree: int, level: int, p: dict, distance: int) -> np.ndarray:
    if len(rows) <= LEAF or level >= p["depth"]:
        return _compare(fp, label, rows, distance)
    r, c = _children(fp[rows], tree, level, p)
    order = np.argsort(c, kind="stable")
    r, c = r[order], c[order]
    for part in np.split(r, np.flatnonzero(np.diff(c)) + 1):
        if len(part) > 1:
            label = _recurse(fp, label, rows[part], tree, level + 1, p, distance)
    return label


# --- DataFrame operators --------------------------------------------------------------------------------------------

_PRINTED = "doc_id bigint, hi bigint, lo bigint"


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo) of the rows that have an id and at least one word. Narrow: no shuffle."""

    def run(batches):
        for batch in batches:
            fp, count = fingerprints(batch.column(1))
            keep = np.flatnonzero(count)
            signed = fp.view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(signed[keep, 0]), pa.array(signed[keep, 1])], ["doc_id", "hi", "lo"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(run, _PRINTED)


def edges(nodes: DataFrame, n: int, distance: int = MAX_DISTANCE, recall: float = RECALL) -> DataFrame:
    """(a, b), a < b: forests whose components are those of the pairs of nodes (node, hi, lo) that were found."""
    p = plan(n, distance, recall)

    def spread(batches):
        for batch in batches:
            fp = np.stack([batch.column(1).to_numpy(), batch.column(2).to_numpy()], axis=1).view(np.uint64)
            node = batch.column(0).to_numpy()
            for tree in range(p["trees"]):
                row, path = np.arange(len(fp)), np.full(len(fp), tree, np.int64)
                for level in range(p["sent"]):
                    r, c = _children(fp[row], tree, level, p)
                    row, path = row[r], path[r] * p["centres"] + c
                kept = fp.view(np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(path), pa.array(np.full(len(row), tree, np.int32)), pa.array(node[row]), pa.array(kept[:, 0]), pa.array(kept[:, 1])], ["list", "tree", "node", "hi", "lo"])

    def pairs(tree: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        node = table["node"].to_numpy()
        fp = np.stack([table["hi"].to_numpy(), table["lo"].to_numpy()], axis=1).view(np.uint64)
        order = np.argsort(node, kind="stable")
        node, fp = node[order], fp[order]
        label = _recurse(fp, np.arange(len(node)), np.arange(len(node)), tree, p["sent"], p, distance)
        tail = np.flatnonzero(label != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[label[tail]]), pa.array(node[tail])], ["a", "b"])

    def search(batches):
        """Rows come sorted by list; a list may go on in the next batch."""
        now, tree, held = None, 0, []
        for batch in batches:
            name = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(name)) + 1), len(name)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and name[a] != now:
                    yield pairs(tree, held)
                    held = []
                now, tree = name[a], batch.column(1)[a].as_py()
                held.append(batch.slice(a, b - a))
        if held:
            yield pairs(tree, held)

    lists = nodes.select("node", "hi", "lo").mapInArrow(spread, "list bigint, tree int, node bigint, hi bigint, lo bigint")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(search, "a bigint, b bigint").distinct()


def components(pairs: DataFrame) -> DataFrame:
    """(node, root): every node of the pairs (a, b) and the smallest node of its component. Alternating large and
    small stars; each round is a table in the shared folder, so a lost executor costs one round at most."""
    now = stored(pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "stars")
    was = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.where("u > v")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").unionByName(least.withColumnRenamed("m", "v")).distinct()
        before, now = now, stored(small, "stars")
        remove(now.sparkSession, before.stored_at)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == was:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        was = state


def members(docs: DataFrame, distance: int = MAX_DISTANCE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hi, lo, group_id, is_kept) of all rows whose text has a copy; rows that repeat both doc_id and
    fingerprint are alike. Nodes of the graph are fingerprints, numbered once in a stored table."""
    printed = stored(fingerprint_table(docs, id_col, text_col), "prints")
    one = printed.groupBy("hi", "lo").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows"))
    nodes = stored(one.select(F.monotonically_increasing_id().alias("node"), "hi", "lo", "first", "rows"), "nodes")
    found = components(edges(nodes, nodes.count(), distance, recall))
    linked = nodes.select("node", "hi", "lo", "first").join(found, "node")
    leads = linked.groupBy("root").agg(F.min(F.struct("first", "hi", "lo")).alias("lead"))
    lead = linked.join(leads, "root").select("node", "lead")
    named = nodes.join(lead, "node", "left").where("rows > 1 OR lead IS NOT NULL").select("hi", "lo", F.coalesce("lead", F.struct("first", "hi", "lo")).alias("lead"))
    kept = (F.col("doc_id") == F.col("lead.first")) & (F.col("hi") == F.col("lead.hi")) & (F.col("lo") == F.col("lead.lo"))
    return printed.join(named, ["hi", "lo"]).select("doc_id", "hi", "lo", F.col("lead.first").alias("group_id"), kept.alias("is_kept"))


def groups(docs: DataFrame, distance: int = MAX_DISTANCE, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, group_id, is_kept) of all documents that have a copy, repeated rows included once per row.
    group_id is the smallest doc_id of the group, which is the one that stays."""
    return members(docs, distance, recall, id_col, text_col).select("doc_id", "group_id", "is_kept")


def printed_rows(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """docs with a column `name` of struct(hi, lo), null for a text without words."""

    @F.arrow_udf("struct<hi:bigint,lo:bigint>")
    def run(column: pa.Array) -> pa.Array:
        fp, count = fingerprints(column)
        signed = fp.view(np.int64)
        return pa.StructArray.from_arrays([pa.array(signed[:, 0]), pa.array(signed[:, 1])], ["hi", "lo"], mask=pa.array(count == 0))

    return docs.withColumn(name, run(F.col(text_col).cast("string")))


def deduplicate(docs: DataFrame, distance: int = MAX_DISTANCE, recall: float = RECALL) -> DataFrame:
    """The rows of docs (all columns) without those that copy a document with a smaller doc_id; of rows that repeat
    both doc_id and text one stays; rows without doc_id or without words stay."""
    member = stored(members(docs, distance, recall), "groups")
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL")
    twice = stored(ids.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    # Both sides grow with the corpus, so this is a shuffled join at every size; hashing the ids spares sorting texts.
    gone = member.where("NOT is_kept").select("doc_id").distinct().join(twice, "doc_id", "left_anti").hint("shuffle_hash")
    if twice.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(twice.hint("shuffle_hash"), "doc_id", "left_anti").join(gone, "doc_id", "left_anti").select(*docs.columns)
    # A repeated doc_id does not say which of its rows is the copy, so these rows alone are printed again.
    mark = "__print"
    while mark in docs.columns:
        mark += "_"
    many = printed_rows(docs.join(twice.hint("shuffle_hash"), "doc_id", "left_semi").select(*docs.columns), "text", mark)
    lost = member.where("NOT is_kept").select("doc_id", F.struct("hi", "lo").alias(mark)).distinct()
    left = many.where(F.col(mark).isNotNull()).join(lost, ["doc_id", mark], "left_anti")
    row = F.struct(*docs.columns)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]
    one = left.groupBy("doc_id", mark).agg(F.min_by(row, F.struct("text", F.xxhash64(*hashed))).alias(mark + "row")).select(mark + "row.*")
    bare = many.where(F.col(mark).isNull()).select(*docs.columns)
    return once.unionByName(bare).unionByName(one.select(*docs.columns))


def brute_force_members(rows: list[tuple[int, str]], distance: int = MAX_DISTANCE) -> list[tuple[int, bool] | None]:
    """For each row (group_id, is_kept) by comparing all pairs, None for a row that belongs to no group; for tests. Rows
    of one group that repeat the leader's doc_id and fingerprint are all kept here; deduplicate() leaves one of them."""
    ids = [r[0] for r in rows]
    fp, count = fingerprints(pa.array([r[1] for r in rows], pa.string()))
    signed = fp.view(np.int64).tolist()
    live = [i for i in range(len(rows)) if ids[i] is not None and count[i]]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in live:
        for j in live:
            if j < i and sum(int(fp[i, w] ^ fp[j, w]).bit_count() for w in range(2)) <= distance:
                root[find(i)] = find(j)
    of: dict[int, list[int]] = {}
    for i in live:
        of.setdefault(find(i), []).append(i)
    out: list[tuple[int, bool] | None] = [None] * len(rows)
    for own in of.values():
        lead = min((ids[i], *signed[i]) for i in own)
        for i in own:
            out[i] = (lead[0], (ids[i], *signed[i]) == lead)
    return out


def brute_force_groups(rows: list[tuple[int, str]], distance: int = MAX_DISTANCE) -> dict[int, int]:
    """doc_id -> smallest doc_id of its group, for rows with distinct ids."""
    return {r[0]: m[0] for r, m in zip(rows, brute_force_members(rows, distance)) if m}
