"""Operator 8: best-two-fit packing of documents into training sequences.

Shards of SHARD documents, dealt out by a row number that is stored with the lengths, are packed independently, a task
each, so that the work is one small shuffle of (doc_id, length) and scales with the number of shards; no key decides
about the shard, so no repeated row, id or length can fill one. What a shard loses is at most its last bins. In a
shard a bin is filled greedily with the longest documents that fit; then its smallest document gives way to the two
unpacked documents that together fit the widened gap most tightly, if they fill it better. A document longer than the
capacity is cut into full bins and a rest, which is packed like a document. Lengths and starts count the token ids that
operator 3 gives the whole text.

Cases: a null or empty text has length 0 and is left out; a null doc_id is packed and listed as null; repeated rows
are packed each; ties go to the smaller doc_id (nulls last), then the smaller length; an empty table gives no bins; a
text of any length is counted whole; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import stored

CAPACITY = 4096  # tokens of a training sequence
SHARD = 20_000

BINS = "bin_id bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<int>, used int"


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers; items of one length are taken in their order. 0 < length <= capacity."""
    queue: dict[int, deque[int]] = {}
    for i, n in enumerate(lengths):
        queue.setdefault(n, deque()).append(i)
    sizes = sorted(queue)  # lengths with unpacked items
    present = np.array(sizes, np.int64)

    def take(n: int) -> int:
        nonlocal present
        item = queue[n].popleft()
        if not queue[n]:
            at = bisect_right(sizes, n) - 1
            del sizes[at], queue[n]
            present = np.delete(present, at)
        return item

    def give(n: int, item: int) -> None:
        nonlocal present
        if n in queue:
            queue[n].appendleft(item)
        else:
            at = bisect_right(sizes, n)
            sizes.insert(at, n)
            queue[n] = deque([item])
            present = np.insert(present, at, n)

    def best_two(gap: int) -> tuple[int, int] | None:
        """The unpacked lengths a >= b with the largest sum of at most gap; of equal sums the largest a."""
        firsts = present[: bisect_right(sizes, gap - 1)]
        if not len(firsts):
            return None
        at = np.searchsorted(present, np.minimum(firsts, gap - firsts), side="right") - 1
        partner = np.where(at >= 0, present[np.maximum(at, 0)], 0)
        for k in np.flatnonzero(partner == firsts):  # the same length twice needs two items
            if len(queue[int(firsts[k])]) < 2:
                partner[k] = present[at[k] - 1] if at[k] > 0 else 0
        total = np.where(partner > 0, firsts + partner, 0)
        top = int(total.max())
        if not top:
            return None
        k = int(np.flatnonzero(total == top)[-1])
        return int(firsts[k]), int(partner[k])

    bins = []
    while sizes:
        chosen: list[tuple[int, int]] = []
        gap = capacity
        while (at := bisect_right(sizes, gap)) and gap:
            n = sizes[at - 1]
            chosen.append((n, take(n)))
            gap -= n
        smallest, item = chosen[-1]
        two = best_two(gap + smallest) if gap and sizes else None
        if two and sum(two) > smallest:
            chosen.pop()
            chosen += [(n, take(n)) for n in two]
            give(smallest, item)
        bins.append([i for _, i in chosen])
    return bins


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, total) of the documents that have any text; total in tokens."""
    return bpe.counts(docs, path, id_col, text_col).where("total > 0")


def pack_shard(frame: pd.DataFrame, capacity: int, shard: int) -> pd.DataFrame:
    """frame: doc_id, total. Bins of the shard, numbered from shard << 32."""
    ids, starts, lengths, full = [], [], [], []
    frame = frame.sort_values(["doc_id", "total"], na_position="last", kind="stable")
    for doc, total in zip(frame["doc_id"].astype("Int64"), frame["total"].tolist()):
        doc = None if doc is pd.NA else int(doc)
        total = int(total)
        whole = total // capacity
        full += [([doc], [k * capacity], [capacity]) for k in range(whole)]
        if total % capacity:
            ids.append(doc)
            starts.append(whole * capacity)
            lengths.append(int(total % capacity))
    rows = full + [([ids[i] for i in b], [starts[i] for i in b], [lengths[i] for i in b]) for b in pack(lengths, capacity)]
    return pd.DataFrame([((shard << 32) + k, *r, sum(r[2])) for k, r in enumerate(rows)], columns=["bin_id", "doc_ids", "starts", "lengths", "used"])


def bins(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """One row per bin: (bin_id, doc_ids, starts, lengths, used); doc_ids[i] fills lengths[i] tokens of the bin with
    its tokens from starts[i] on."""
    found = stored(pieces(docs, id_col, text_col, path).withColumn("row", F.monotonically_increasing_id()), "lengths")
    shards = -(-found.count() // shard) or 1

    def run(batches):
        held = [pa.Table.from_batches([b]) for b in batches]
        if not held:
            return
        frame = pa.concat_tables(held).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
        for number, own in frame.groupby("shard"):
            made = pack_shard(own[["doc_id", "total"]], capacity, int(number))
            kinds = [("bin_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("used", pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(made[c].tolist(), t) for c, t in kinds], [c for c, _ in kinds])

    placed = found.select("doc_id", "total", F.pmod("row", F.lit(shards)).cast("int").alias("shard"))
    return placed.repartitionById(shards, "shard").mapInArrow(run, BINS)
