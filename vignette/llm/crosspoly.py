"""Operator 10: approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) turns unit vectors; the nearest signed
axis is the hash. A table's key joins as many hashes as N needs, the last one on the first few rotated coordinates only,
so that the number of buckets follows N smoothly. Every row is indexed: it lies in one bucket of each table. A query
looks into the buckets that lose at most `limit` against its own (multiprobe), so hard queries look into more than easy
ones. Candidates are ranked exactly, by matrix products of a bucket's queries and members.

Equal vectors are one member with the k + 1 smallest ids, which are all that can matter, and one query, so that copies
cost nothing. Buckets lie in groups, the unit of the shuffle: a member is sent once a table, a query once for each group
that it looks into, with the list of its buckets there. A group of more than MOST members or queries is cut into
blocks of both, which meet pairwise.

The plan is set from the data: the exact neighbours of SAMPLE queries are found by brute force (linear in N); for every
bucket size and number of tables in question `limit` is the loss that catches TARGET of them, and the plan is taken
whose estimated work (vectors sent and pairs scored) is least. The limit has no upper bound, so the recall does not depend
on how the vectors lie; on vectors without any structure a query meets a share of them that falls slowly with N.

Cases: rows without id, without vector, of another dimension than most, with NaN or infinite parts or of length zero
are neither queries nor neighbours; rows that repeat an id are one (the least vector); equal similarities rank by id;
fewer rows than k + 1 give shorter lists; an empty table gives none; other columns are not looked at.
"""

from __future__ import annotations

import functools
import itertools
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, mix, stored

K = 10
SIZES = (512, 128, 32)  # members of a bucket on average, in question
TABLES = (1, 2, 4, 8)
WHOLE = 128  # up to so many vectors are one bucket
GROUP = 4096  # members of a group of buckets on average
MOST = 16_384  # members and queries that meet in one task at once
SENT = 150  # pairs that are scored in the time that sending a vector takes
SAMPLE = 512
TARGET = 0.95
SEED = 5


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (a power of two long), scaled to keep lengths."""
    n, d = x.shape
    x, h = x.copy(), 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.concatenate([x[:, :, :1] + x[:, :, 1:], x[:, :, :1] - x[:, :, 1:]], axis=2)
        h *= 2
    return x.reshape(n, d) / np.float32(np.sqrt(d))


def shape(buckets: int, dimension: int) -> list[int]:
    """Coordinates that each hash of a key looks at, for about so many buckets: whole rotations, and a part of one."""
    size = 1 << max(1, (dimension - 1).bit_length())
    out = []
    while buckets > 1:
        part = min(size, max(2, 1 << (int(buckets).bit_length() - 2)))
        out.append(part)
        buckets //= 2 * part
    return out


@functools.lru_cache(maxsize=512)
def _signs(table: int, which: int, size: int) -> np.ndarray:
    return np.random.default_rng([SEED, table, which]).choice(np.array([-1.0, 1.0], np.float32), (3, size))


def axes(x: np.ndarray, table: int, parts: list[int]) -> list[np.ndarray]:
    """For each hash of the key the values of all signed axes: (n, 2 * part), + before -."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    padded = np.zeros((len(x), size), np.float32)
    padded[:, : x.shape[1]] = x
    out = []
    for which, part in enumerate(parts):
        y = padded
        for signs in _signs(table, which, size):
            y = hadamard(y * signs)
        y = y[:, :part]
        out.append(np.concatenate([y, -y], axis=1))
    return out


def own_bucket(x: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    key = np.zeros(len(x), np.int64)
    for value, part in zip(axes(x, table, parts), parts):
        key = key * (2 * part) + value.argmax(axis=1)
    return key


def losses(x: np.ndarray, y: np.ndarray, pair: np.ndarray, table: int, parts: list[int]) -> np.ndarray:
    """What the bucket of y[i] loses for the query x[pair[i]]: the squared distances from its best axes to that of y[i]."""
    out = np.zeros(len(pair), np.float32)
    for a, b in zip(axes(x, table, parts), axes(y, table, parts)):
        out += (a.max(axis=1)[pair] - a[pair, b.argmax(axis=1)]) ** 2
    return out


def probed(x: np.ndarray, table: int, parts: list[int], limit: float, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of all buckets that lose at most `limit`; a query's own bucket is among them."""
    rows, keys = [], []
    for first in range(0, len(x), step):
        row = np.arange(len(part_x := x[first : first + step]))
        key, loss = np.zeros(len(row), np.int64), np.zeros(len(row), np.float32)
        for value, part in zip(axes(part_x, table, parts), parts):
            lost = (value.max(axis=1, keepdims=True) - value) ** 2
            order = np.argsort(lost, axis=1, kind="stable")
            lost = np.take_along_axis(lost, order, 1)
            count = np.concatenate([(lost[row[a : a + 65536]] <= (limit - loss[a : a + 65536])[:, None]).sum(axis=1) for a in range(0, len(row), 65536)])
            again = np.repeat(np.arange(len(row)), count)
            nth = np.arange(len(again)) - np.repeat(np.cumsum(count) - count, count)
            key = key[again] * (2 * part) + order[row[again], nth]
            loss = loss[again] + lost[row[again], nth]
            row = row[again]
        rows.append(row + first)
        keys.append(key)
    return np.concatenate(rows), np.concatenate(keys)


def top(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(scores, ids) of the k best of each row; equal scores by id."""
    if score.shape[1] > 4 * k:
        part = np.argpartition(-score, k - 1, axis=1)[:, :k]
        edge = np.take_along_axis(score, part, 1).min(axis=1, keepdims=True)
        tied = np.flatnonzero((score >= edge).sum(axis=1) > k)
        got, name = np.take_along_axis(score, part, 1), ids[part]
        for r in tied:
            pick = np.flatnonzero(score[r] >= edge[r, 0])
            pick = pick[np.lexsort((ids[pick], -score[r, pick]))][:k]
            got[r], name[r] = score[r, pick], ids[pick]
    else:
        got, name = score, np.broadcast_to(ids, score.shape)
    order = np.lexsort((name, -got), axis=1)[:, :k]
    return np.take_along_axis(got, order, 1), np.take_along_axis(name, order, 1)


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimension)


def _fingerprints(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of float32 rows; equal rows have equal ones."""
    bits = (x + np.float32(0)).view(np.uint32).astype(np.uint64)
    out = []
    for k in range(2):
        odd = np.random.default_rng([SEED, k]).integers(0, 2**63, x.shape[1], np.uint64) * np.uint64(2) + np.uint64(1)
        out.append(mix((mix(bits + np.uint64(k + 1)) * odd).sum(axis=1, dtype=np.uint64)).view(np.int64))
    return out[0], out[1]


UNIT = "id bigint, h1 bigint, h2 bigint, v array<float>"


def unit_vectors(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, h1, h2, v) with one unit vector per id and its fingerprint, stored in the shared folder, and the dimension."""
    bounded_batches(rows.sparkSession)
    raw = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    sizes = raw.groupBy(F.size("v").alias("d")).count().where("d > 0").orderBy(F.desc("count"), "d").first()
    dimension = sizes["d"] if sizes else 1
    sound = raw.where(F.size("v") == dimension).where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e150)))

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)
            length = np.sqrt((x * x).sum(axis=1))
            keep = np.flatnonzero(length > 1e-150)
            unit = (x[keep] / length[keep, None]).astype(np.float32)
            h1, h2 = _fingerprints(unit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep)), pa.array(h1), pa.array(h2), _lists(unit)], ["id", "h1", "h2", "v"])

    one = sound.groupBy("id").agg(F.min("v").alias("v"))
    return stored(one.mapInArrow(run, UNIT), "vectors"), dimension


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))


def distinct(units: DataFrame, most: int | None) -> DataFrame:
    """(n, ids, h1, h2, v): equal vectors are one row; n is the smallest id, ids are the `most` smallest (None: n alone)."""
    if most is None:
        return units.groupBy("h1", "h2").agg(F.min("id").alias("n"), F.first("v").alias("v")).select("n", "h1", "h2", "v")
    first = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    few = units.withColumn("r", first).where(F.col("r") <= most)
    return few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v")).select(F.element_at("ids", 1).alias("n"), "ids", "h1", "h2", "v")


def exact(members: DataFrame, ids: np.ndarray, own: np.ndarray, queries: np.ndarray, dimension: int, k: int) -> dict[int, list[int]]:
    """Brute-force neighbours of a few queries, those with the fingerprint `own` left out: every task sends its k best, at
    most k * len(ids) numbers."""

    def run(batches):
        score, name = np.empty((len(ids), 0), np.float32), np.empty((len(ids), 0), np.int64)
        for batch in batches:
            n = batch.column(0).to_numpy()
            s = queries @ _matrix(batch.column(2), dimension).T
            s[own[:, None] == batch.column(1).to_numpy()] = -2
            a, b = top(s, n, k)
            score, name = np.concatenate([score, a], axis=1), np.concatenate([name, b], axis=1)
            order = np.lexsort((name, -score), axis=1)[:, :k]
            score, name = np.take_along_axis(score, order, 1), np.take_along_axis(name, order, 1)
        q, c = np.nonzero(score > -2)
        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(name[q, c]), pa.array(score[q, c])], ["q", "n", "s"])

    found = members.select("n", "h1", "v").mapInArrow(run, "q bigint, n bigint, s float").groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("s")).alias("s"), "n"))), 1, k).alias("best"))
    return {r["q"]: [b["n"] for b in r["best"]] for r in found.collect()}


class Plan(NamedTuple):
    parts: list[int]
    tables: int
    limit: float
    groups: int  # of each table
    share: float  # of the members that a query meets, repeats counted

    def group(self, bucket: np.ndarray) -> np.ndarray:
        """Neighbouring buckets share a group."""
        return bucket * self.groups // int(np.prod([2 * p for p in self.parts]))


def plan(members: DataFrame, asked: DataFrame, n: int, dimension: int, k: int, target: float = TARGET) -> Plan:
    """The cheapest plan that catches `target` of the exact neighbours of a sample of the queries."""
    if n <= WHOLE:
        return Plan([], 1, 0.0, 1, 1.0)
    hashed = asked.withColumn("hash", F.xxhash64("n"))
    bound = hashed.select("hash").orderBy("hash").limit(SAMPLE).agg(F.max("hash")).first()[0]  # no task sends vectors that are not needed
    sample = hashed.where(F.col("hash") <= (0 if bound is None else bound)).orderBy("hash", "n").limit(SAMPLE).collect()
    ids, q = np.array([r["n"] for r in sample], np.int64), np.array([r["v"] for r in sample], np.float32).reshape(-1, dimension)
    near = exact(members, ids, np.array([r["h1"] for r in sample], np.int64), q, dimension, k)
    wanted = sorted({m for v in near.values() for m in v})
    if not wanted:
        return Plan([], 1, 0.0, 1, 1.0)
    held = members.select("n", "v").join(F.broadcast(members.sparkSession.createDataFrame([(m,) for m in wanted], "n bigint")), "n").collect()  # SAMPLE * k rows at most
    place = {r["n"]: i for i, r in enumerate(held)}
    y = np.array([r["v"] for r in held], np.float32)
    pair = np.array([(i, place[m]) for i, a in enumerate(ids.tolist()) for m in near.get(a, [])])
    return cheapest(q, y[pair[:, 1]], pair[:, 0], n, asked.count(), target)


def cheapest(q: np.ndarray, y: np.ndarray, pair: np.ndarray, n: int, asked: int, target: float) -> Plan:
    """pair[i] is the query in q to which the vector y[i] is near."""
    best, found = None, None
    groups = max(1, -(-n // GROUP))
    for size in SIZES:
        parts = shape(n // size, q.shape[1])
        if not parts:
            continue
        buckets, least = int(np.prod([2 * p for p in parts])), np.full(len(pair), np.inf, np.float32)
        for table in range(max(TABLES)):
            least = np.minimum(least, losses(q, y, pair, table, parts))
            if table + 1 not in TABLES:
                continue
            limit = float(np.sort(least)[int(np.ceil(target * len(least))) - 1]) * (1 + 1e-5) + 1e-7
            made = Plan(parts, table + 1, limit, min(groups, buckets), 1.0)
            some = q[:64]
            row, bucket = probed(some, table, parts, limit)
            sent = len(np.unique(row * made.groups + made.group(bucket))) / len(some)
            share = (table + 1) * len(bucket) / len(some) / buckets
            work = (table + 1) * (n + asked * sent) * SENT + asked * share * n
            if best is None or work < best:
                best, found = work, made._replace(share=share)
    return found or Plan([], 1, 0.0, 1, 1.0)


SENT_ROWS = "slot bigint, part int, role int, id bigint, buckets array<bigint>, v array<float>"


def _scored(x: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], held: np.ndarray, name: np.ndarray, matrix: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, name, score) of the k best members in the buckets that each row looks into. held: the members' buckets, sorted."""
    row, bucket = pairs
    order = np.argsort(bucket, kind="stable")
    row, bucket = row[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
    low, high = np.searchsorted(held, bucket[first]), np.searchsorted(held, bucket[first], side="right")
    least = np.full(len(x), -2.0, np.float32)  # what a member must reach to be among the best of the row
    kept, many, most = [], 0, max(1 << 14, 4 * k * len(x))

    def settle() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r, m, s = (np.concatenate(c) if c else np.empty(0, t) for c, t in zip(zip(*kept) if kept else ((), (), ()), (np.int64, np.int64, np.float32)))
        o = np.lexsort((name[m], -s, r))
        r, m, s = r[o], m[o], s[o]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        least[r[nth == k - 1]] = s[nth == k - 1]
        return r[nth < k], m[nth < k], s[nth < k]

    for a, b, c, d in zip(first.tolist(), last.tolist(), low.tolist(), high.tolist()):
        if c == d:
            continue
        for e in range(a, b, 4096):
            r = row[e : min(b, e + 4096)]
            s = x[r] @ matrix[c:d].T
            i, j = np.nonzero(s >= least[r][:, None])
            kept.append((r[i], j + c, s[i, j]))
            many += len(i)
        if many > most:
            kept = [settle()]
            many = len(kept[0][0])
    r, m, s = settle()
    return r, name[m], s


def neighbours(rows: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", target: float = TARGET, every: int = 1, using: Plan | None = None) -> DataFrame:
    """(vec_id, neighbor_id, similarity, rank): the k rows of largest cosine similarity to every row whose id is divisible
    by `every`, itself excluded."""
    units, dimension = unit_vectors(rows, id_col, vector_col)
    chosen = units.where(F.col("id") % every == 0)
    members, asked = stored(distinct(units, k + 1), "members"), stored(distinct(chosen, None), "asked")
    p = plan(members, asked, members.count(), dimension, k, target) if using is None else using

    def member_slots(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
        bucket = own_bucket(x, table, p.parts)
        return p.group(bucket) * p.tables + table, bucket

    def query_slots(x: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, slot, offsets of its buckets, buckets)."""
        row, bucket = probed(x, table, p.parts, p.limit)
        order = np.lexsort((bucket, row))
        row, bucket = row[order], bucket[order]
        group = p.group(bucket)
        head = np.flatnonzero(np.concatenate([[True], (np.diff(row) != 0) | (np.diff(group) != 0)]))
        return row[head], group[head] * p.tables + table, np.append(head, len(row)).astype(np.int32), bucket

    def sizes(role: int):
        def run(batches):
            slots = []
            for batch in batches:
                x = _matrix(batch.column(1), dimension)
                for table in range(p.tables):
                    slots.append(member_slots(x, table)[0] if role == 0 else query_slots(x, table)[1])
            if slots:
                slot, n = np.unique(np.concatenate(slots), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(n)], ["slot", "n"])

        return run

    count = lambda df, role: df.select("n", "v").mapInArrow(sizes(role), "slot bigint, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") > MOST).collect()
    # A number for each group that is to be cut: at most tables * N / MOST of them.
    wide, long = ({r["slot"]: -(-r["n"] // MOST) for r in count(df, role)} for df, role in ((members, 0), (asked, 1)))

    def blocks(slot: np.ndarray, name: np.ndarray, mine: dict, other: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index, own block, block of the other side) of every copy: a row of a cut group meets all of the other side."""
        a, b = (np.array([of.get(s, 1) for s in slot.tolist()], np.int64) for of in (mine, other))
        own = (mix(name.astype(np.uint64)) % a.astype(np.uint64)).astype(np.int64)
        index = np.repeat(np.arange(len(slot)), b)
        nth = np.arange(len(index)) - np.repeat(np.cumsum(b) - b, b)
        return index, own[index], nth

    def place(role: int):
        def run(batches):
            for batch in batches:
                name, x = batch.column(0).to_numpy(), _matrix(batch.column(1), dimension)
                for lo in range(0, len(x), 4096):
                    for table in range(p.tables):
                        if role == 0:
                            slot, bucket = member_slots(x[lo : lo + 4096], table)
                            row, edge = np.arange(len(slot)), np.arange(len(slot) + 1, dtype=np.int32)
                        else:
                            row, slot, edge, bucket = query_slots(x[lo : lo + 4096], table)
                        row = row + lo
                        lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(bucket))
                        if wide or long:
                            mine, other = (wide, long) if role == 0 else (long, wide)
                            index, own, nth = blocks(slot, name[row], mine, other)
                            many = np.array([wide.get(s, 1) for s in slot[index].tolist()], np.int64)
                            part = own + nth * many if role == 0 else nth + own * many
                            row, slot, lists = row[index], slot[index], lists.take(pa.array(index))
                        else:
                            part = np.zeros(len(row), np.int64)
                        for a in range(0, len(row), 8192):
                            r = pa.array(row[a : a + 8192])
                            yield pa.RecordBatch.from_arrays([pa.array(slot[a : a + 8192]), pa.array(part[a : a + 8192].astype(np.int32)), pa.array(np.full(len(r), role, np.int32)), batch.column(0).take(r), lists.slice(a, 8192), batch.column(1).take(r)], ["slot", "part", "role", "id", "buckets", "v"])

        return run

    def rank(batches):
        """Sorted by slot, part and role: the members come before the queries that look at them."""
        now, ids, at, held, ready = None, [], [], [], None
        for batch in batches:
            slot, part, role = (batch.column(i).to_numpy() for i in range(3))
            own, lists, x = batch.column(3).to_numpy(), batch.column(4), _matrix(batch.column(5), dimension)
            edge, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            turn = np.flatnonzero((np.diff(slot) != 0) | (np.diff(part) != 0) | (np.diff(role) != 0)) + 1
            for a, b in itertools.pairwise([0, *turn, len(slot)]):
                if a == b:
                    continue
                if (slot[a], part[a]) != now:
                    now, ids, at, held, ready = (slot[a], part[a]), [], [], [], None
                if role[a] == 0:
                    ids.append(own[a:b])
                    at.append(flat[edge[a:b]])
                    held.append(x[a:b])
                    continue
                if ready is None:
                    if not held:
                        continue
                    bucket = np.concatenate(at)
                    order = np.argsort(bucket, kind="stable")
                    ready, held = (bucket[order], np.concatenate(ids)[order], np.concatenate(held)[order]), []
                size = np.diff(edge[a : b + 1])
                row, name, s = _scored(x[a:b], (np.repeat(np.arange(b - a), size), flat[edge[a] : edge[b]]), *ready, k + 1)
                bounds = pa.array(np.searchsorted(row, np.arange(b - a + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(own[a:b]), pa.ListArray.from_arrays(bounds, pa.array(name)), pa.ListArray.from_arrays(bounds, pa.array(s))], ["q", "n", "s"])

    def join(batches):
        """Sorted by query; the last query of a batch may go on in the next."""
        left = None
        for batch in batches:
            q, size = batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy())
            now = [np.repeat(q, size), batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()]
            if left is not None:
                now = [np.concatenate([a, b]) for a, b in zip(left, now)]
            if not len(now[0]):
                continue
            edge = np.searchsorted(now[0], now[0][-1])
            left = [a[edge:] for a in now]
            if edge:
                yield _best(*(a[:edge] for a in now), k + 1)
        if left is not None and len(left[0]):
            yield _best(*left, k + 1)

    sent = members.select("n", "v").mapInArrow(place(0), SENT_ROWS).unionByName(asked.select("n", "v").mapInArrow(place(1), SENT_ROWS))
    tasks = int(units.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # fixed: the rows are few, the work on them is not
    lists = sent.repartition(tasks, "slot", "part").sortWithinPartitions("slot", "part", "role").mapInArrow(rank, "q bigint, n array<bigint>, s array<float>")
    best = lists.repartition("q").sortWithinPartitions("q").mapInArrow(join, "q bigint, n bigint, s double")
    # k + 1 members of each query give its ids; every row with the query's vector then leaves itself out.
    named = best.join(members.select("n", F.explode("ids").alias("id")), "n")
    order = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    few = named.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).groupBy("q").agg(F.array_sort(F.collect_list(F.struct("r", "id", "s"))).alias("l"))
    rows_of = chosen.select("id", "h1", "h2").join(asked.select(F.col("n").alias("q"), "h1", "h2"), ["h1", "h2"]).select(F.col("id").alias("vec_id"), "q").join(few, "q")
    own = rows_of.select("vec_id", F.posexplode(F.slice(F.filter("l", lambda x: x["id"] != F.col("vec_id")), 1, k)).alias("i", "x"))
    return own.select("vec_id", F.col("x.id").alias("neighbor_id"), F.col("x.s").alias("similarity"), (F.col("i") + 1).alias("rank"))


def _best(q: np.ndarray, n: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best members of each query, one row per pair."""
    order = np.lexsort((-s, n, q))
    q, n, s = q[order], n[order], s[order].astype(np.float64)
    new = np.concatenate([[True], (q[1:] != q[:-1]) | (n[1:] != n[:-1])]) if len(q) else np.empty(0, bool)
    q, n, s = q[new], n[new], s[new]
    order = np.lexsort((n, -s, q))
    q, n, s = q[order], n[order], s[order]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return pa.RecordBatch.from_arrays([pa.array(q[keep]), pa.array(n[keep]), pa.array(s[keep])], ["q", "n", "s"])
