"""Incremental ingestion of places: each batch of a stream is resolved against the stored canonicals near it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.places import DEDUP_METRES, canonical_places, near_pairs
from ..scratch import stored, temporary

#: Degrees of a tile; buckets of ids of a new store (more for a store of billions and small batches).
TILE, ID_BUCKETS = 0.05, 64
#: Versions of a tile or bucket that become one; it is looked for them after as many batches.
MOST_VERSIONS = 16
#: Touched tiles or buckets are read by their names up to so many, beyond by one look over all folders.
LISTED = 2_000
_COLUMNS = ["place_id", "name", "normalized_name", "lon", "lat", "created_at"]


class Bucketed:
    """A table in folders by bucket, kind and version: a batch adds a version (`delta`) to the buckets that it
    has rows of; once a bucket has MOST_VERSIONS of them, they are written as one (`base`, up to a version) and
    removed. Readers take a bucket's latest base and the versions after it, so that a run that ends between
    writing and removing changes nothing. Only versions before the batch at hand are ever merged: a batch that
    is run again finds what it found."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.columns = spark, path, [c.split()[0] for c in schema.split(", ")]
        self.schema = f"{schema}, bucket string, kind string, version int"

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def read(self, version: int, buckets: list[str] | None = None) -> DataFrame:
        """The rows up to a version, of some buckets or all, with bucket, kind and version."""
        path, fs = self._fs()
        if buckets is not None and len(buckets) <= LISTED:
            at = [p for p in (f"{self.path}/bucket={b}" for b in buckets) if fs.exists(path(p))]
        else:
            at = [self.path] if fs.exists(path(self.path)) else []
        if not at:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*at).where(F.col("version") <= version)
        if buckets is not None and len(buckets) > LISTED:
            rows = rows.join(F.broadcast(self.spark.createDataFrame([(b,) for b in buckets], "bucket string")), "bucket", "left_semi")
        bases = rows.where("kind = 'base'").groupBy("bucket").agg(F.max("version").alias("_base"))
        current = (F.col("kind") == "base") & (F.col("version") == F.col("_base")) | (F.col("kind") == "delta") & (F.col("version") > F.coalesce("_base", F.lit(-1)))
        return rows.join(F.broadcast(bases), "bucket", "left").where(current).drop("_base")

    def _write(self, rows: DataFrame, kind: str, version: int) -> None:
        rows = rows.select(*self.columns, "bucket", F.lit(kind).alias("kind"), F.lit(version).alias("version"))
        rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "kind", "version").parquet(self.path)

    def add(self, rows: DataFrame, version: int) -> None:
        self._write(rows, "delta", version)

    def merge(self, version: int) -> list[str]:
        """Merges the versions up to this one of those buckets that have many, found by the names of folders
        and the files' ends; gives the buckets merged."""
        many = self.read(version).groupBy("bucket").agg(F.countDistinct("kind", "version").alias("n")).where(F.col("n") >= MOST_VERSIONS)
        names = [r.bucket for r in many.collect()]
        if names:
            self._write(stored(self.read(version, names)), "base", version)
            path, fs = self._fs()
            for name in names:
                for kind, before in (("delta", version + 1), ("base", version)):
                    at = path(f"{self.path}/bucket={name}/kind={kind}")
                    for entry in fs.listStatus(at) if fs.exists(at) else ():
                        if int(entry.getPath().getName().split("=")[1]) < before:
                            fs.delete(entry.getPath(), True)
        return names


def tile_of(lon: Column, lat: Column) -> Column:
    return F.concat_ws("_", F.floor(lat / TILE), F.floor(lon / TILE))


def tiles_around(lon: Column, lat: Column) -> Column:
    """The tiles in which places within the distance of a match may lie."""
    north = DEDUP_METRES / 111_320 * 1.001
    east = F.lit(north) / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + north, F.lit(90.0)))), F.lit(1e-6))
    rows = F.sequence(F.floor((lat - north) / TILE), F.floor((lat + north) / TILE))
    columns = F.sequence(F.floor((lon - east) / TILE), F.floor((lon + east) / TILE))
    return F.flatten(F.transform(rows, lambda y: F.transform(columns, lambda x: F.concat_ws("_", y, x))))


class PlaceStore:
    """Canonical places by tile, and the canonical of every id by bucket of ids. A batch reads the tiles around
    its new places and the buckets of its ids, not the store."""

    def __init__(self, spark: SparkSession, path: str, id_buckets: int = ID_BUCKETS):
        self.spark, self.id_buckets = spark, id_buckets
        path = path.rstrip("/")
        self._places = Bucketed(spark, f"{path}/places", "place_id string, name string, normalized_name string, lon double, lat double, created_at long")
        self._ids = Bucketed(spark, f"{path}/ids", "place_id string, canonical_id string")

    def places(self, version: int) -> DataFrame:
        """The canonical places as of a version since the last merge."""
        return self._places.read(version).select(*_COLUMNS)

    def aliases(self, version: int) -> DataFrame:
        return self._ids.read(version).where("place_id <> canonical_id").select("place_id", "canonical_id")

    def add(self, batch: DataFrame, batch_id: int) -> None:
        """Known ids and aliases stay as they are; new places become aliases of the first canonical place
        that says the same nearby, or canonical ones. The order is (created_at, place_id); stored places come
        before new ones. Places without a position are canonical."""
        with temporary(self.spark):
            first = batch.groupBy("place_id").agg(F.min_by(F.struct(*_COLUMNS), "created_at").alias("r")).select("r.*")
            first = stored(first.withColumn("bucket", F.pmod(F.xxhash64("place_id"), F.lit(self.id_buckets)).cast("string")))
            buckets = [r.bucket for r in first.select("bucket").distinct().collect()]  # id_buckets at most
            known = self._ids.read(batch_id - 1, buckets).select("place_id")
            new = stored(first.join(known, "place_id", "left_anti"))
            around = new.select(F.explode(tiles_around(F.col("lon"), F.col("lat"))).alias("tile")).distinct().limit(LISTED + 1)
            tiles = [r.tile for r in around.collect()]
            old = self._places.read(batch_id - 1, tiles if len(tiles) <= LISTED else None)
            near = near_pairs(old.select(*_COLUMNS), new.select("lon", "lat"), DEDUP_METRES).select("l.*").dropDuplicates(["place_id"])
            both = near.withColumn("created_at", F.col("created_at") - F.lit(1 << 60)).unionByName(new.select(near.columns))
            found = stored(canonical_places(both).join(new.select("place_id", "bucket"), "place_id"))
            tile = F.coalesce(F.when(F.col("lon").isNotNull() & F.col("lat").isNotNull(), tile_of(F.col("lon"), F.col("lat"))), F.lit("none"))
            kept = new.join(found.where("place_id = canonical_id").select("place_id"), "place_id", "left_semi").withColumn("bucket", tile)
            self._places.add(kept, batch_id)
            self._ids.add(found, batch_id)
            if batch_id and batch_id % MOST_VERSIONS == 0:
                self._places.merge(batch_id - 1)
                self._ids.merge(batch_id - 1)


def ingest(places: DataFrame, store: PlaceStore, checkpoint: str) -> StreamingQuery:
    """Starts the stream; batch numbers are the stream's own, so a restart goes on where it was."""
    return places.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, k: store.add(batch, k)).trigger(availableNow=True).start()
