"""Operator 1: quality classifier, a byte-level convolutional network in numpy.

A document's UTF-8 is cut into overlapping chunks of CHUNK bytes that cover all of it. Learned filters of WIDTH bytes
move over each chunk in steps of STEP; each filter's largest response in a chunk is pooled; the pooled responses, as
their mean and their maximum over the chunks, make one probability of good quality. The network is trained on labelled
documents, TRAIN_DOCS of each class at most, in the order of a hash (this bound is the only sampling), and a held-out
fifth of them sets the threshold, so that KEEP_GOOD of good documents are kept.

Cases: a null or empty text has no probability and is not kept; a document however long is read whole; if the labels
lack one class nothing can be learnt: the probability is null and all texts are kept; several labels of one document
count as the lowest; repeated rows get equal results; a probability equal to the threshold is kept; labels of unknown
documents and labels other than 0 and 1 teach nothing; an empty table gives no rows; ids that are no number become null;
other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, slices, utf8

TRAIN_DOCS = 1200
CHUNK, OVERLAP = 512, 64
WIDTH, STEP = 8, 4
EMBED, FILTERS = 8, 24
KEEP_GOOD = 0.99
EPOCHS = 4

_POSITIONS = (CHUNK - WIDTH) // STEP + 1


def chunked(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(chunks, row): CHUNK bytes each, zero beyond a document's end, and the document of each; empty rows have none."""
    size = np.diff(offsets)
    move = CHUNK - OVERLAP
    count = np.where(size > 0, np.maximum(1, -(-(size - OVERLAP) // move)), 0)
    row = np.repeat(np.arange(len(size)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[row] + nth * move
    padded = np.concatenate([raw, np.zeros(CHUNK, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[start] if len(row) else np.zeros((0, CHUNK), np.uint8)
    left = offsets[row + 1] - start
    short = np.flatnonzero(left < CHUNK)
    out = np.ascontiguousarray(out)
    out[short] *= np.arange(CHUNK) < left[short][:, None]
    return out, row


class Network:
    def __init__(self, seed: int = 3):
        g = np.random.default_rng(seed)
        emb = (g.standard_normal((256, EMBED)) * 0.5).astype(np.float32)
        emb[0] = 0
        self.w = {"emb": emb, "f": (g.standard_normal((WIDTH * EMBED, FILTERS)) / np.sqrt(WIDTH * EMBED)).astype(np.float32), "fb": np.zeros(FILTERS, np.float32), "o": (g.standard_normal(2 * FILTERS) * 0.1).astype(np.float32), "ob": np.zeros(1, np.float32)}
        self.threshold = 0.5

    def responses(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(windows unfolded, filter responses) of chunks."""
        x = self.w["emb"][chunks]
        view = np.lib.stride_tricks.as_strided(x, (len(x), _POSITIONS, WIDTH * EMBED), (x.strides[0], x.strides[1] * STEP, x.strides[2]))
        u = view.reshape(-1, WIDTH * EMBED)
        return u, (u @ self.w["f"]).reshape(len(x), _POSITIONS, FILTERS)

    def pooled(self, chunks: np.ndarray, block: int = 128) -> np.ndarray:
        out = np.empty((len(chunks), FILTERS), np.float32)
        for a in range(0, len(chunks), block):
            out[a : a + block] = self.responses(chunks[a : a + block])[1].max(axis=1)
        return np.maximum(out + self.w["fb"], 0)

    def combine(self, pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
        mean = np.add.reduceat(pool, first, axis=0) / count[:, None]
        return np.concatenate([mean, np.maximum.reduceat(pool, first, axis=0)], axis=1)

    def probabilities(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One probability per document; NaN for empty ones."""
        out = np.full(len(offsets) - 1, np.nan)
        for a, b in slices(offsets, 1 << 22):
            chunks, row = chunked(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            if len(row):
                have, first, count = np.unique(row, return_index=True, return_counts=True)
                z = self.combine(self.pooled(chunks), first, count) @ self.w["o"] + self.w["ob"]
                out[a + have] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
        return out

    def train(self, texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, budget: int = 96, rate: float = 4e-3, seed: int = 5) -> None:
        """Adam over batches of whole documents with `budget` chunks or more; classes weigh the same."""
        g = np.random.default_rng(seed)
        m, s = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        weight = np.where(label == 1, len(label) / (2 * max(1, label.sum())), len(label) / (2 * max(1, (1 - label).sum()))).astype(np.float32)
        step = 0
        for _ in range(epochs):
            batch: list[int] = []
            held = 0
            order = g.permutation(len(texts))
            for k, i in enumerate(order):
                batch.append(i)
                held += -(-len(texts[i]) // (CHUNK - OVERLAP))
                if held < budget and k + 1 < len(order):
                    continue
                step += 1
                for name, grad in self._gradients([texts[j] for j in batch], label[batch], weight[batch]).items():
                    m[name] = 0.9 * m[name] + 0.1 * grad
                    s[name] = 0.999 * s[name] + 0.001 * grad * grad
                    self.w[name] = (self.w[name] - rate * (m[name] / (1 - 0.9**step)) / (np.sqrt(s[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                batch, held = [], 0

    def _gradients(self, texts: list[bytes], label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        chunks, row = chunked(np.frombuffer(b"".join(texts), np.uint8), offsets)
        _, first, count = np.unique(row, return_index=True, return_counts=True)
        u, z = self.responses(chunks)
        at = z.argmax(axis=1)
        pool = np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0] + w["fb"], 0)
        feature = self.combine(pool, first, count)
        logit = feature @ w["o"] + w["ob"]
        d = (weight * (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - label) / len(texts)).astype(np.float32)
        grad = {"o": feature.T @ d + 1e-4 * w["o"], "ob": d.sum(keepdims=True)}
        df = d[:, None] * w["o"]
        dpool = (df[:, :FILTERS] / count[:, None])[row]
        top = feature[:, FILTERS:][row] == pool
        ties = np.add.reduceat(top.astype(np.float32), first, axis=0)
        dpool = dpool + top * (df[:, FILTERS:] / ties)[row]
        dpool *= pool > 0
        grad["fb"] = dpool.sum(axis=0)
        flat = np.arange(len(chunks))[:, None] * _POSITIONS + at  # the window that each filter chose
        grad["f"] = np.empty_like(w["f"])
        demb = np.zeros_like(w["emb"])
        for j in range(FILTERS):
            grad["f"][:, j] = u[flat[:, j]].T @ dpool[:, j]
            back = (dpool[:, j, None] * w["f"][:, j]).reshape(-1, EMBED)
            seen = np.lib.stride_tricks.sliding_window_view(chunks, WIDTH, axis=1)[np.arange(len(chunks)), at[:, j] * STEP].ravel()
            for e in range(EMBED):
                demb[:, e] += np.bincount(seen, back[:, e], 256)
        demb[0] = 0
        grad["emb"] = demb
        return grad


def learn(texts: list[bytes], label: np.ndarray, keep_good: float = KEEP_GOOD) -> Network | None:
    """The trained network, its threshold set on every fifth text; None if a class is missing."""
    use = [i for i, t in enumerate(texts) if t]
    texts, label = [texts[i] for i in use], label[use]
    if len(set(label.tolist())) < 2:
        return None
    held = np.arange(len(texts)) % 5 == 4
    if len(set(label[~held].tolist())) < 2 or not label[held].any():
        held[:] = False
    net = Network()
    net.train([t for t, h in zip(texts, held) if not h], label[~held])
    test = held if held.any() else ~held
    some = [t for t, h in zip(texts, test) if h]
    p = net.probabilities(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in some])]))
    good = np.sort(p[label[test] == 1])
    net.threshold = float(min(0.5, good[int((1 - keep_good) * len(good))]))
    return net


def fit(docs: DataFrame, labels: DataFrame, each: int = TRAIN_DOCS) -> Network | None:
    """Learns from `each` labelled documents of either class at most."""
    order = Window.partitionBy("quality").orderBy(F.xxhash64("id"), "id")
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col("quality").cast("int").alias("quality")).where("id IS NOT NULL AND quality IN (0, 1)")
    chosen = known.groupBy("id").agg(F.min("quality").alias("quality")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= each).select("id", "quality")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).collect()  # 2 * each rows at most
    rows.sort(key=lambda r: r["id"])
    return learn([r["text"].encode() for r in rows], np.array([r["quality"] for r in rows], np.int64))


def classify(docs: DataFrame, net: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, probability, keep) of every row; no shuffle, the weights (a few KB) go along with the tasks."""

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            if net is None:
                p, keep = pa.nulls(batch.num_rows, pa.float64()), pa.array(np.diff(offsets) > 0)
            else:
                found = net.probabilities(raw, offsets)
                p, keep = pa.array(found, mask=np.isnan(found)), pa.array(np.nan_to_num(found, nan=-1.0) >= net.threshold)
            yield pa.RecordBatch.from_arrays([batch.column(0), p, keep], ["doc_id", "probability", "keep"])

    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, probability double, keep boolean")
