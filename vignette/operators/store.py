"""A vector table with the verbs of a store: immutable DataFrames in, DataFrames out; Store keeps them as Parquet."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def fetch(points: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    """The points whose key is wanted; the planner broadcasts the wanted keys if they are few."""
    return points.join(wanted.select(*key).distinct(), key, "left_semi")


def absent(batch: DataFrame, points: DataFrame, key: str = "id") -> DataFrame:
    return batch.join(points.select(key), key, "left_anti")


def latest(batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """One row a key: the last one by `order`, without it the last in the batch. An aggregate, so that a key with many rows
    is reduced before the shuffle."""
    at = F.col(order) if order else F.monotonically_increasing_id()
    rows = batch.select(F.col(key).alias("__key"), F.struct(*batch.columns).alias("__row"), at.alias("__at"))
    return rows.groupBy("__key").agg(F.max_by("__row", "__at").alias("__row")).select("__row.*")


def upsert(points: DataFrame, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
    """Batch rows replace points of their id; of a batch's rows of one id the last wins."""
    batch = latest(batch, key, order)
    return points.join(batch.select(key), key, "left_anti").select(*points.columns).unionByName(batch.select(*points.columns))


def add(points: DataFrame, batch: DataFrame, key: str = "id") -> DataFrame:
    """Like upsert, but an id that exists or that the batch repeats fails the call."""
    if not fetch(batch, points, [key]).isEmpty():
        raise ValueError("some ids exist already")
    if not batch.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError("the batch repeats some ids")
    return points.unionByName(batch.select(*points.columns))


def update(points: DataFrame, changes: DataFrame) -> DataFrame:
    """changes (id, document, metadata, metadata_given, embedding): null keeps a field; metadata_given with a null
    clears the metadata."""
    c = changes.select("id", *[F.col(x).alias(f"__{x}") for x in ("document", "metadata", "metadata_given", "embedding")])
    merged = points.join(c, "id", "left")
    return merged.select("id", F.coalesce("__document", "document").alias("document"), F.when(F.coalesce("__metadata_given", F.lit(False)), F.col("__metadata")).otherwise(F.coalesce("__metadata", "metadata")).alias("metadata"), F.coalesce("__embedding", "embedding").alias("embedding"))


def delete(points: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Without the ids of `gone`; if one of them does not exist, nothing is deleted and the call fails."""
    if not absent(gone, points, key).isEmpty():
        raise KeyError("some ids do not exist")
    return points.join(gone.select(key), key, "left_anti")


def scroll(points: DataFrame, limit: int | None = None, offset: int = 0, key: str = "id") -> DataFrame:
    """A page in the order of the id. A limit of 0 still returns one row, as the store that this follows does."""
    page = points.orderBy(key).offset(offset)
    return page if limit is None else page.limit(max(1, limit))


class Store:
    """Named tables under a folder that all executors share, written through the folder's own file system.

    A table is a list of parts, Parquet folders, that a manifest names; the manifest of the highest number counts and
    appears by a rename, so that a reader never sees half a write and a new Store finds the tables of an old one. An
    upsert writes its batch alone; reading merges the parts, later ones first, and COMPACT parts are merged into one.
    One writer at a time per table: a second one that writes the same number fails."""

    COMPACT = 8

    def __init__(self, spark: SparkSession, folder: str, dimension: int = 768):
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension
        self._jvm = spark.sparkContext._jvm
        self._fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _list(self, *parts: str) -> list[str]:
        at = self._path(*parts)
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _manifest(self, name: str) -> tuple[int, dict] | None:
        found = [x for x in self._list(name) if x.startswith("manifest-") and x.endswith(".json")]
        if not found:
            return None
        file = self._fs.open(self._path(name, found[-1]))
        try:
            return int(found[-1][9:-5]), json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _commit(self, name: str, number: int, told: dict) -> None:
        draft, final = self._path(name, f".draft-{uuid.uuid4().hex}"), self._path(name, f"manifest-{number:012d}.json")
        file = self._fs.create(draft, True)
        file.write(bytearray(json.dumps(told).encode()))
        file.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise RuntimeError(f"another writer has changed {name}")
        for old in self._list(name):  # the manifest before stays for readers that hold it
            if old.startswith("manifest-") and int(old[9:-5]) < number - 1:
                self._fs.delete(self._path(name, old), False)
        keep = set(told["parts"]) | set((self._before(name, number) or {}).get("parts", []))
        for part in self._list(name):
            if part.startswith("part-") and part not in keep:
                self._fs.delete(self._path(name, part), True)

    def _before(self, name: str, number: int) -> dict | None:
        path = self._path(name, f"manifest-{number - 1:012d}.json")
        if not self._fs.exists(path):
            return None
        file = self._fs.open(path)
        try:
            return json.loads(bytes(file.readAllBytes()).decode())
        finally:
            file.close()

    def _write(self, name: str, rows: DataFrame) -> str:
        part = f"part-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{name}/{part}")
        return part

    def _read(self, name: str, part: str, schema: str) -> DataFrame:
        return self.spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(f"{self.folder}/{name}/{part}")

    def exists(self, name: str) -> bool:
        return self._manifest(name) is not None

    def names(self) -> list[str]:
        return [n for n in self._list() if self.exists(n)]

    def parts(self, name: str) -> int:
        found = self._manifest(name)
        return len(found[1]["parts"]) if found else 0

    def get(self, name: str) -> DataFrame:
        found = self._manifest(name)
        if found is None:
            raise KeyError(name)
        told = found[1]
        rows, *later = (self._read(name, part, told["schema"]) for part in told["parts"])
        for delta in later:  # the rows of a part have different ids
            rows = rows.join(delta.select(told["key"]), told["key"], "left_anti").select(*rows.columns).unionByName(delta)
        return rows

    def put(self, name: str, rows: DataFrame, key: str = "id") -> DataFrame:
        """The table anew."""
        found = self._manifest(name)
        schema = rows.schema
        for field in schema.fields:
            field.nullable = True
        self._commit(name, found[0] + 1 if found else 0, {"parts": [self._write(name, rows)], "key": key, "schema": schema.json()})
        return self.get(name)

    def create(self, name: str, schema: str, key: str = "id") -> None:
        """No-op if it exists."""
        if not self.exists(name):
            self.put(name, self.spark.createDataFrame([], schema), key)

    def reset(self, name: str | None = None) -> None:
        """Deletes a table, or all of them, with their files."""
        for n in [name] if name else self.names():
            self._fs.delete(self._path(n), True)

    def upsert(self, name: str, batch: DataFrame, key: str = "id", order: str | None = None) -> DataFrame:
        batch = latest(batch, key, order)
        found = self._manifest(name)
        if found is None:
            return self.put(name, batch, key)
        number, told = found
        columns = [f["name"] for f in json.loads(told["schema"])["fields"]]
        parts = [*told["parts"], self._write(name, batch.select(*columns))]
        self._commit(name, number + 1, told | {"parts": parts})
        return self.put(name, self.get(name), told["key"]) if len(parts) >= self.COMPACT else self.get(name)

    def index_movie(self, scenes: DataFrame, sentences: DataFrame, key: str = "id") -> int:
        """Upserts both levels of some movies, one write a level; an empty side writes nothing. Returns the writes."""
        writes = 0
        for name, rows in (("scenes", scenes), ("sentences", sentences)):
            if not rows.isEmpty():
                self.upsert(name, rows, key)
                writes += 1
        return writes

    def count(self, name: str) -> int:
        return self.get(name).count()

    def tune(self, name: str, files: int | None = None, sort: list[str] | None = None) -> DataFrame:
        """Rewrites a table as one part for the way it is read: in `files` files, rows sorted by `sort` (a movie's rows in few
        files, so that filters on it skip the others)."""
        found = self._manifest(name)
        if found is None:
            raise KeyError(name)
        rows = self.get(name)
        if sort:
            rows = (rows.repartitionByRange(files, *sort) if files else rows.repartitionByRange(*sort)).sortWithinPartitions(*sort)
        elif files:
            rows = rows.repartition(files)
        return self.put(name, rows, found[1]["key"])
