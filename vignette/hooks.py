"""Where models plug in. Every hook is a plain callable; what ships here is deterministic and needs no model.

An encoder takes a list of texts and returns a float array (n, dimension); encode() runs it over Arrow batches. A
translator takes a question and returns JSON text; translate() checks it. An extractor takes texts and returns rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.vocabulary import PREDICATES
from .plans.pattern import Pattern

Encoder = Callable[[Sequence[str]], np.ndarray]


def hashing_encoder(dimension: int = 768) -> Encoder:
    """Signed feature hashing of words; for tests and as a baseline without a model."""

    def run(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            for w in re.findall(r"\w+", t.lower()):
                h = xxhash.xxh64_intdigest(w)
                out[i, h % dimension] += 1.0 if h >> 63 else -1.0
        return out

    return run


def encode(rows: DataFrame, encoder: Encoder, dimension: int, text: str = "text", to: str = "embedding") -> DataFrame:
    """rows with unit-length vectors. A blank text or a wrong dimension fails the query; a zero vector stays zero."""
    schema = rows.withColumn(to, F.lit(None).cast("array<float>")).schema
    at = rows.columns.index(text)

    def run(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("cannot encode a blank text")
            v = np.asarray(encoder(texts), np.float32)
            if v.shape != (len(texts), dimension):
                raise ValueError(f"the encoder returned {v.shape}, expected {(len(texts), dimension)}")
            length = np.linalg.norm(v, axis=1, keepdims=True)
            v = np.divide(v, length, out=np.zeros_like(v), where=length > 0)
            made = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dimension), pa.array(v.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, to])

    return rows.mapInArrow(run, schema)


@dataclass(frozen=True)
class Translation:
    status: str  # unavailable, skipped, translated or failed
    pattern: Pattern | None = None
    error: str | None = None


def keyword_translator(question: str, limit: int = 10) -> str:
    """The predicates whose verb stems occur in the question, in its order; skips if there is none."""
    low = question.lower()
    stems = {p: p.split("_")[0].lower().rstrip("s")[:6] for p in PREDICATES}
    found = sorted((low.find(stem), p) for p, stem in stems.items() if re.search(rf"\b{re.escape(stem)}", low))
    if not found:
        return json.dumps({"skip_graph": True, "reason": "no known relation in the question"})
    return json.dumps({"predicates": [p for _, p in found][:3], "limit": limit})


def translate(question: str, limit: int, translator: Callable[[str, int], str] | None) -> Translation:
    """A question as a pattern; whatever goes wrong is told in the status."""
    if translator is None:
        return Translation("unavailable", error="no translator is set")
    try:
        raw = re.sub(r"^```(?:json)?\s*|\s*```$", "", translator(question, limit).strip())
        told = json.loads(raw)
        if told.get("skip_graph"):
            return Translation("skipped", error=told.get("reason"))
        return Translation("translated", Pattern(told.get("predicates") or [], told.get("entity_types"), told.get("movie_ids"), told.get("contains_entities"), told.get("limit") or limit))
    except Exception as e:  # a translator is somebody else's code
        return Translation("failed", error=str(e))


def capitalised_names(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, label, ord): runs of capitalised words as persons, each once, in order of first sight."""
    found = texts.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(r"(?U)\b([A-Z][a-z]+(?: [A-Z][a-z]+)*+)\b"), 1)).alias("ord", "text"))
    return found.groupBy(key, "text").agg(F.min("ord").alias("ord")).select(key, "text", F.lit("PERSON").alias("label"), "ord")
