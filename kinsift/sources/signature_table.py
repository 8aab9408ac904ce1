"""The signature table as generations of one bucketed table: lookups without a shuffle of it, writes as large as the change.

Rows are bucketed by path and each scan adds a generation with its new and changed files, and with those hits
whose ``seen`` has grown old, so that pruning never drops a file that scans still meet. A path's row is that of
its latest generation. Buckets make that choice, and the join of a scan's files to it, local to the table. A
generation is written by overwriting its own partition, so a scan that is run again changes nothing. Compaction
writes the rows that stay as one generation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kinsift.storage import materialize

#: Days after which a hit's ``seen`` is written again. Well below the days that prune() keeps.
REFRESH_DAYS = 7


@dataclass(frozen=True)
class SignatureTable:
    """A table by its catalogue name; ``columns`` are path, size, mtime_ns, seen and signatures."""

    spark: SparkSession
    name: str
    location: str
    columns: tuple[str, ...]

    @classmethod
    def create(cls, spark: SparkSession, name: str, location: str, schema: str, buckets: int) -> SignatureTable:
        """Opens the table at location, with the generations that lie there, or makes an empty one. schema: DDL of its columns."""
        fields = StructType.fromDDL(schema)
        ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"create table if not exists {name} ({ddl}, gen bigint) using parquet partitioned by (gen) clustered by (path) into {buckets} buckets location '{location}'")
        place = spark._jvm.org.apache.hadoop.fs.Path(location)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
            spark.sql(f"alter table {name} recover partitions")
        return cls(spark, name, location.rstrip("/"), tuple(f.name for f in fields))

    @property
    def buckets(self) -> int:
        described = self.spark.sql(f"describe extended {self.name}").filter("col_name = 'Num Buckets'").first()
        return int(described.data_type)

    def latest(self, below: int) -> DataFrame:
        """Each path's row of its latest generation below a number; deleted paths have none."""
        self.spark.catalog.refreshTable(self.name)  # another session may have written
        rows = self.spark.table(self.name).filter(F.col("gen") < below)
        own = [c for c in self.columns if c != "path"]
        found = rows.groupBy("path").agg(F.max_by(F.struct(*own), "gen").alias("_row"))
        return found.select("path", *(F.col(f"_row.{c}").alias(c) for c in own)).select(*self.columns)

    def lookup(self, files: DataFrame, below: int) -> DataFrame:
        """files with ``hit`` and the columns of their row, null unless path, size and mtime agree. Only files are shuffled."""
        extra = [c for c in self.columns if c not in ("path", "size", "mtime_ns")]
        known = self.latest(below).withColumnsRenamed({"path": "_path", "size": "_size", "mtime_ns": "_mtime"} | {c: f"_{c}_known" for c in extra})
        rows = files.drop(*extra).join(known, F.col("path") == F.col("_path"), "left")
        hit = F.coalesce((F.col("size") == F.col("_size")) & (F.col("mtime_ns") == F.col("_mtime")), F.lit(False))
        kept = [c for c in files.columns if c not in extra]
        return rows.select(*kept, hit.alias("hit"), *(F.when(hit, F.col(f"_{c}_known")).alias(c) for c in extra))

    def write(self, rows: DataFrame, gen: int) -> None:
        """Writes rows as one generation, in place of an earlier attempt at it. Rows may come from this table, so they are written aside first."""
        materialize(rows.select(*self.columns), "generation").repartition(self.buckets, "path").createOrReplaceTempView("kinsift_generation")
        self.spark.sql(f"insert overwrite table {self.name} partition (gen = {gen}) select * from kinsift_generation")

    def upsert(self, looked_up: DataFrame, fresh: DataFrame, gen: int, seen: Column, refresh_days: int = REFRESH_DAYS) -> None:
        """Adds generation gen: fresh rows of missed files, and hits of lookup(files, gen) whose seen is older than refresh_days."""
        old = looked_up.filter("hit").filter(F.coalesce(F.col("seen") < seen - F.make_interval(days=F.lit(refresh_days)), F.lit(True)))
        touched = old.withColumn("seen", seen)
        self.write(fresh.withColumn("seen", seen).select(*self.columns).unionByName(touched.select(*self.columns)), gen)

    def prune(self, below: int, now: Column, days: int = 90) -> DataFrame:
        """Rows seen within the last days."""
        return self.latest(below).filter(F.col("seen") >= now - F.make_interval(days=F.lit(days)))

    def compact(self, gen: int, rows: DataFrame | None = None) -> None:
        """Writes rows (default: all of the latest) as generation gen, then drops the generations below it."""
        self.write(self.latest(gen) if rows is None else rows, gen)
        for (low,) in self.spark.table(self.name).filter(F.col("gen") < gen).select("gen").distinct().collect():  # a row per scan since the last time
            self.spark.sql(f"alter table {self.name} drop partition (gen = {low})")
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.location}/gen={low}")  # the table is external: its files stay otherwise
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)

    def rows_of(self, gen: int) -> int:
        self.spark.catalog.refreshTable(self.name)
        return self.spark.table(self.name).filter(F.col("gen") == gen).count()
