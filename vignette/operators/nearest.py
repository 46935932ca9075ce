"""Exact cosine ranking.

A single query vector is a literal: one projection and a top-k. A batch is a join of blocks: queries and corpus are
packed into rows of many vectors and stored; every pair of blocks is one matrix product in an Arrow batch. A block of
queries meets the corpus blocks of a partition one after the other and keeps its k best so far: a product in single
precision shows which pairs can still be among them, only these are scored in double precision, and only the k best leave
the task. A window ranks what is left. Packing needs no shuffle. No side is collected or has to fit a broadcast. The
work is queries times corpus by nature: for large corpora use the inverted lists of operators/index.py, which compare a
query with the lists that it probes.

Rows without id or vector take no part, on either side; a vector with a null part counts as none; vectors of different
lengths fail the query.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine
from ..storage import bounded_batches, stored

DIGITS = 6  # scores are rounded before they rank, so that the last bits decide nothing
PART_BYTES = 128 << 20  # of corpus blocks that a task holds
HELD = 1 << 22  # results that a worker keeps before it passes them on, and as many numbers of query vectors


def search(corpus: DataFrame, query: Sequence[float], k: int = 20, key: Sequence[str] = ("vec_id",), movie_id: str | None = None, vector: str = "embedding") -> DataFrame:
    """The k rows nearest to one vector, with `score`; ties by key. The movie filter reaches the scan."""
    rows = corpus if movie_id is None else corpus.where(F.col("movie_id") == movie_id)
    wanted = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", F.round(cosine(F.col(vector), wanted), DIGITS)).orderBy(F.desc("score"), *key).limit(k)


def _blocks(rows: DataFrame, id_col: str, vector: str, size: int, prefix: str, group: str | None, keep: bool, packed: bool = False) -> DataFrame:
    """Rows of up to `size` vectors that lie together. With keep, a block holds one group only; else every vector brings its
    group's hash. packed: as bytes, which pass from and to Python as they are."""
    code = F.xxhash64(group) if group else F.lit(0).cast("bigint")
    sound = F.col(id_col).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array()), lambda x: x.isNull())
    flat = rows.where(sound).select(F.col(id_col).cast("bigint").alias("i"), F.col(vector).cast("array<double>").alias("v"), code.alias("g"), *([F.col(group).alias("group")] if keep else []))
    kind = f", group {flat.schema['group'].dataType.simpleString()}" if keep else ""

    def pack(batches):
        for batch in batches:
            if keep:
                batch = pa.Table.from_batches([batch]).sort_by("g").combine_chunks().to_batches()[0] if batch.num_rows else batch
            edge = batch.column(1).offsets.to_numpy()
            wide = np.diff(edge)
            if len(wide) and (wide != wide[0]).any():
                raise ValueError(f"vectors of different lengths: {sorted(set(wide.tolist()))[:5]}")
            ids, code = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            turn = (np.flatnonzero(np.diff(code)) + 1).tolist() if keep else []
            cuts = [0, *turn, len(code)]
            starts = [(a, min(a + size, d)) for c, d in zip(cuts[:-1], cuts[1:]) for a in range(c, d, size)]
            if not starts:
                continue
            width = int(wide[0])
            if packed:
                flat = batch.column(1).flatten().to_numpy().reshape(len(ids), width)
                made = [pa.array([x[a:b].tobytes() for a, b in starts], pa.binary()) for x in (ids, flat, code)]
            else:
                lists = lambda column, scale: pa.ListArray.from_arrays(pa.array(np.array([starts[0][0], *[b for _, b in starts]], np.int32) * scale), column)
                made = [lists(batch.column(0), 1), lists(batch.column(1).flatten(), width), lists(batch.column(2), 1)]
            yield pa.RecordBatch.from_arrays([*made, *([batch.column(3).take(pa.array([a for a, _ in starts]))] if keep else [])], [f"{prefix}_ids", f"{prefix}_flat", f"{prefix}_groups", *(["group"] if keep else [])])

    types = ("binary", "binary") if packed else ("array<bigint>", "array<double>")
    return flat.mapInArrow(pack, f"{prefix}_ids {types[0]}, {prefix}_flat {types[1]}, {prefix}_groups {types[0]}{kind}")


def _pairs(left: DataFrame, right: DataFrame, group: str | None) -> DataFrame:
    """Every block of queries beside every block of the corpus, or of its group, all of one query block in turn as far as they
    are in one partition. Query blocks are dealt out to all cores, by a salt where groups are few; the corpus lies in as few
    partitions as a task's memory allows."""
    spark = left.sparkSession
    bounded_batches(spark)
    left, right = stored(left, "blocks").withColumn("q_no", F.monotonically_increasing_id()), stored(right, "blocks")
    columns = ["q_no", "q_ids", "q_flat", "q_groups", "c_ids", "c_flat", "c_groups"]
    cores = spark.sparkContext.defaultParallelism
    if group:
        salts = -(-2 * cores // max(1, right.select(group).distinct().count()))
        copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        return left.withColumn("salt", F.pmod("q_no", F.lit(salts)).cast("int")).join(copies, [group, "salt"]).select(*columns)
    size = right.agg(F.sum(F.length("c_flat"))).first()[0] or 0
    # without the hint few queries would be broadcast, and the corpus with its few partitions would be dealt out to as few tasks
    return left.repartition(4 * cores).crossJoin(right.coalesce(max(1, -(-size // PART_BYTES))).hint("shuffle_replicate_nl")).select(*columns)


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x), where=length > 0)


def _vectors(ids: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return flat.reshape(len(ids), -1)


def _met(batches, begin, results):
    """Feeds pairs of blocks to one state a query block, made by begin(ids, vectors, groups), and yields what they hold. Before a
    pair is met, all states together hold less than HELD results, in whatever order the pairs come."""
    held, kept, numbers = {}, 0, 0
    for batch in batches:
        number = batch.column(0).to_pylist()
        for r in range(batch.num_rows):
            q_ids, q, q_g, c_ids, c, c_g = (np.frombuffer(batch.column(i)[r].as_buffer(), t) for i, t in zip(range(1, 7), (np.int64, np.float64, np.int64) * 2))
            if not len(q_ids) or not len(c_ids):
                continue
            if kept >= HELD or numbers >= HELD and number[r] not in held:
                yield from (y for x in held.values() for y in results(x))
                held, kept, numbers = {}, 0, 0
            if number[r] not in held:
                held[number[r]] = begin(q_ids.copy(), _vectors(q_ids, q).copy(), q_g.copy())
                numbers += q.size
            state = held[number[r]]
            kept -= state.held()
            state.add(c_ids, _vectors(c_ids, c), c_g)
            kept += state.held()
    yield from (y for x in held.values() for y in results(x))


class _Best:
    """The k best corpus rows of every query of a block so far, by rounded score, then id."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, groups: np.ndarray, k: int, exclude_same: bool, other: bool):
        self.ids, self.x, self.groups, self.k, self.exclude_same, self.other = ids, x, groups, k, exclude_same, other
        self.lengths, self.single = np.linalg.norm(x, axis=1), _unit(x).astype(np.float32)
        self.least = np.full(len(ids), -2.0, np.float32)  # below it no pair of the query can be among the k best
        self.slack = np.float32(10.0**-DIGITS + (x.shape[1] + 16) * 2.0**-23)  # rounding and single precision
        self.rows, self.found, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new: list = []
        self.waiting = 0

    def held(self) -> int:
        return len(self.rows) + self.waiting

    def add(self, c_ids: np.ndarray, y: np.ndarray, groups: np.ndarray) -> None:
        near = self.single @ _unit(y).astype(np.float32).T
        if not np.isfinite(y).all():
            near[:, ~np.isfinite(y).all(axis=1)] = -4
        if self.exclude_same:
            near[self.ids[:, None] == c_ids[None, :]] = -4
        if self.other:
            near[self.groups[:, None] == groups[None, :]] = -4
        if not len(self.rows) and not self.waiting and len(c_ids) > self.k:
            kth = np.partition(near, len(c_ids) - self.k, axis=1)[:, len(c_ids) - self.k]
            self.least = np.maximum(kth - 2 * self.slack, np.float32(-2))
        rows, at = np.divmod(np.flatnonzero(near >= self.least[:, None]), len(c_ids))
        lengths = np.linalg.norm(y, axis=1)
        scores = np.empty(len(rows))
        for a in range(0, len(rows), 1 << 15):
            r, c = rows[a : a + (1 << 15)], at[a : a + (1 << 15)]
            size = self.lengths[r] * lengths[c]
            scores[a : a + (1 << 15)] = np.divide(np.einsum("ij,ij->i", self.x[r], y[c]), size, out=np.zeros(len(r)), where=size > 0)
        self.new.append((rows, c_ids[at], np.round(scores, DIGITS)))
        self.waiting += len(rows)
        if self.waiting > max(self.k * len(self.ids) // 2, len(self.rows) // 2):
            self.settle()

    def settle(self) -> None:
        if not self.new:
            return
        rows, found, scores = (np.concatenate([old, *[n[i] for n in self.new]]) for i, old in enumerate((self.rows, self.found, self.scores)))
        self.new, self.waiting = [], 0
        order = np.lexsort((found, -scores, rows))
        rows = rows[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(len(self.ids)))[rows]
        stays = place < self.k
        self.rows, self.found, self.scores = rows[stays], found[order][stays], scores[order][stays]
        last = place[stays] == self.k - 1
        self.least[self.rows[last]] = np.maximum(self.scores[last].astype(np.float32) - self.slack, np.float32(-2))


def block_top_k(queries: DataFrame, corpus: DataFrame, k: int, query_id: str = "query_id", query: str = "q", corpus_id: str = "vec_id", vector: str = "embedding", exclude_same: bool = False, block: int = 1024, same: str | None = None, other: str | None = None) -> DataFrame:
    """(query_id, corpus_id, score, rank): the k nearest corpus rows of every query, by score, then corpus id. `same`
    names a column that both sides share: only equal rows meet. `other` names one in which they must differ."""
    group = same or other
    left, right = _blocks(queries, query_id, query, block, "q", group, bool(same), True), _blocks(corpus, corpus_id, vector, block, "c", group, bool(same), True)

    def product(batches):
        def results(best):
            best.settle()
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[best.rows]), pa.array(best.found), pa.array(best.scores)], ["query_id", "corpus_id", "score"])

        yield from _met(batches, lambda ids, x, groups: _Best(ids, x, groups, k, exclude_same, bool(other)), results)

    found = _pairs(left, right, "group" if same else None).mapInArrow(product, "query_id bigint, corpus_id bigint, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


class _GroupBest:
    """The best score of every query of a block in every group that it has met."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, groups: np.ndarray):
        self.ids, self.x, self.best = ids, _unit(x), {}

    def held(self) -> int:
        return len(self.ids) * len(self.best)

    def add(self, c_ids: np.ndarray, y: np.ndarray, groups: np.ndarray) -> None:
        order = np.argsort(groups, kind="stable")
        names = groups[order]
        first = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        best = np.maximum.reduceat(self.x @ _unit(y[order]).T, first, axis=1)
        for i, name in enumerate(names[first].tolist()):
            old = self.best.get(name)
            self.best[name] = best[:, i].copy() if old is None else np.maximum(old, best[:, i])


def block_group_best(queries: DataFrame, corpus: DataFrame, group: str, query_id: str = "query_id", query: str = "q", corpus_id: str = "vec_id", vector: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, group, score): the best score of every query in every group of corpus rows. Groups lie together in the
    blocks, and a query block keeps one score a group, so what leaves a task is a row for each group, not for each vector."""
    laid = corpus.select(corpus_id, vector, group).repartition(F.col(group)).sortWithinPartitions(group)
    left, right = _blocks(queries, query_id, query, block, "q", None, False, True), _blocks(laid, corpus_id, vector, block, "c", group, False, True)

    def product(batches):
        def results(state):
            for name, best in state.best.items():
                yield pa.RecordBatch.from_arrays([pa.array(state.ids), pa.array(np.full(len(best), name)), pa.array(np.round(best, DIGITS))], ["query_id", "code", "score"])

        yield from _met(batches, _GroupBest, results)

    found = _pairs(left, right, None).mapInArrow(product, "query_id bigint, code bigint, score double")
    names = corpus.select(group, F.xxhash64(group).alias("code")).distinct()
    return found.groupBy("query_id", "code").agg(F.max("score").alias("score")).join(names, "code").select("query_id", group, "score")
