"""Deterministic identifiers as expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slug, squeeze

#: Namespace of point ids. Data that was indexed under another namespace passes its own.
NAMESPACE = uuid.UUID("a1b2c3d4-e5f6-7890-abcd-ef1234567890")


def uuid5(name: Column, namespace: uuid.UUID = NAMESPACE) -> Column:
    """RFC 4122 name-based id (SHA-1), as Python's uuid.uuid5 gives it."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def scene_point_id(movie_id: Column, scene_id: Column) -> Column:
    return uuid5(F.concat(movie_id, F.lit("::"), scene_id))


def sentence_point_id(movie_id: Column, scene_id: Column, position: Column) -> Column:
    return uuid5(F.concat(movie_id, F.lit("::"), scene_id, F.lit("::"), position.cast("string")))


def movie_id(title: Column) -> Column:
    return F.translate(F.lower(title), " -", "__")


def scene_id(index: Column) -> Column:
    return F.format_string("scene_%04d", index.cast("int"))


def entity_id(movie: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", movie, F.lower(kind), slug(name))


def relation_id(movie: Column, source: Column, predicate: Column, target: Column, evidence: Column) -> Column:
    joined = F.concat_ws("||", movie, source, predicate, target, squeeze(F.coalesce(evidence, F.lit(""))))
    return F.concat(movie, F.lit(":rel:"), F.substring(F.sha1(joined), 1, 16))
