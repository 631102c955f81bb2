"""A store of keyed rows that is read by bucket: for stores too large to be joined whole with each run's few keys.

Rows lie in one Parquet folder per bucket of the key; a merge writes the touched buckets anew (Spark's dynamic partition
overwrite) and leaves the others alone. Beside them lie Bloom filters of each bucket's keys, in pages of 32,768 bits, so that
a look-up reads only buckets that may hold one of its keys: unknown keys, the usual case of a labelling run, cost no
reading of rows.

Columns: key (string), created_ms (long) and any others. A key has one row, the newest; of equally old ones the largest in
the columns' order. Null keys are not kept and never found; repeated keys of a look-up count once.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..sources.scratch import stored

#: Bits of a page of a Bloom filter, as Spark's bitmap functions have them; bits for each key; hashes of a key.
PAGE_BITS, KEY_BITS, HASHES = 32_768, 10, 5


@dataclass(frozen=True)
class KeyedStore:
    """A store's place and shape; the number of buckets never changes."""

    path: str
    schema: StructType
    buckets: int = 256

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def rows(self, spark: SparkSession, touched: list[int] | None = None) -> DataFrame:
        """The rows of the touched buckets (None: of all), without opening the others' files."""
        df = spark.read.schema(StructType([*self.schema.fields, *StructType.fromDDL("bucket int").fields])).parquet(f"{self.path}/rows")
        return df if touched is None else df.where(F.col("bucket").isin(touched))

    def filters(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema("page int, pages int, bits binary, bucket int").parquet(f"{self.path}/filters")


def create(spark: SparkSession, path: str, schema: StructType | str, buckets: int = 256) -> KeyedStore:
    """An empty store at a path that driver and executors share; the path must be new."""
    store = KeyedStore(path, StructType.fromDDL(schema) if isinstance(schema, str) else schema, buckets)
    _write(spark.createDataFrame([], store.schema).withColumn("bucket", F.lit(0)), f"{path}/rows", "errorifexists")
    _write(spark.createDataFrame([], "page int, pages int, bits binary, bucket int"), f"{path}/filters", "errorifexists")
    return store


def _write(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _places(key: Column, pages: Column) -> Column:
    """The bits of a key in a filter of so many pages."""
    bits = pages.cast("long") * PAGE_BITS
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(i)), bits) for i in range(1, HASHES + 1)])


def _filters_of(rows: DataFrame) -> DataFrame:
    """Bloom filters of the buckets of ``rows`` (key, bucket): one row for each page."""
    pages = rows.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") * KEY_BITS / PAGE_BITS), F.lit(1)).cast("int").alias("pages"))
    bits = rows.join(F.broadcast(pages), "bucket").select("bucket", "pages", F.explode(_places(F.col("key"), F.col("pages"))).alias("bit"))
    paged = bits.select("bucket", "pages", F.floor(F.col("bit") / PAGE_BITS).cast("int").alias("page"), (F.col("bit") % PAGE_BITS).alias("bit"))
    # Spark's bit positions count from 0 within a page.
    return paged.groupBy("bucket", "page").agg(F.first("pages").alias("pages"), F.bitmap_construct_agg("bit").alias("bits")).select("page", "pages", "bits", "bucket")


def possible(store: KeyedStore, keys: DataFrame) -> DataFrame:
    """key and bucket of those keys that the filters don't rule out, each once."""
    filters = store.filters(keys.sparkSession)
    sizes = filters.groupBy("bucket").agg(F.first("pages").alias("pages"))
    asked = keys.select("key").where("key is not null").distinct().withColumn("bucket", store.bucket(F.col("key"))).join(F.broadcast(sizes), "bucket")
    bits = asked.select("key", "bucket", F.explode(F.array_distinct(_places(F.col("key"), F.col("pages")))).alias("bit"))
    bits = bits.select("key", "bucket", F.floor(F.col("bit") / PAGE_BITS).cast("int").alias("page"), (F.col("bit") % PAGE_BITS).cast("int").alias("at"))
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    met = bits.join(filters.select("bucket", "page", "bits"), ["bucket", "page"], "left").withColumn("is_set", byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("at") % 8).cast("int"))) != 0)
    return met.groupBy("key", "bucket").agg(F.min(F.coalesce("is_set", F.lit(False))).alias("all")).where("all").select("key", "bucket")


def look_up(store: KeyedStore, keys: DataFrame) -> DataFrame:
    """The store's rows of the given keys. The buckets to read, at most ``buckets`` numbers, are known before any row is read."""
    found = stored(possible(store, keys), "store-keys")
    touched = sorted(r.bucket for r in found.select("bucket").distinct().collect())
    rows = store.rows(keys.sparkSession, touched)
    return rows.join(found, ["bucket", "key"]).select(*store.schema.names)


def merge(store: KeyedStore, new: DataFrame, now_ms: int | None = None, ttl: str = "ttl_ms") -> list[int]:
    """Put new rows in, the newest row of a key stays; with ``now_ms`` rows of the touched buckets that have outlived ``ttl`` go.

    Only buckets of the new rows are read and written; their numbers are returned.
    """
    spark, names = new.sparkSession, store.schema.names
    fresh = stored(new.select(*names).where("key is not null").withColumn("bucket", store.bucket(F.col("key"))), "store-new")
    touched = sorted(r.bucket for r in fresh.select("bucket").distinct().collect())
    if not touched:
        return []
    every = store.rows(spark, touched).where("key is not null").unionByName(fresh)
    order = F.struct("created_ms", *[c for c in names if c not in ("key", "created_ms")])
    newest = every.groupBy("bucket", "key").agg(F.max(order).alias("r")).select("bucket", "key", "r.*").select(*names, "bucket")
    if now_ms is not None:
        newest = newest.where(F.lit(now_ms) - F.col("created_ms") <= F.col(ttl))
    merged = stored(newest, "store-merged")
    _write(merged.repartition("bucket"), f"{store.path}/rows")
    _write(_filters_of(merged.select("key", "bucket")), f"{store.path}/filters")
    # Buckets that have no row left keep neither rows nor a filter that rules anything in.
    emptied = sorted(set(touched) - {r.bucket for r in merged.select("bucket").distinct().collect()})
    if emptied:
        _empty(store, spark, emptied)
    return touched


def _empty(store: KeyedStore, spark: SparkSession, emptied: list[int]) -> None:
    """A bucket's last rows outlived their time: its filter becomes one page without a bit, its rows one with a null key."""
    numbers = spark.createDataFrame([(b,) for b in emptied], "bucket int")
    _write(numbers.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema.fields], "bucket"), f"{store.path}/rows")
    _write(numbers.select(F.lit(0).alias("page"), F.lit(1).alias("pages"), F.unhex(F.lit("00" * (PAGE_BITS // 8))).alias("bits"), "bucket"), f"{store.path}/filters")
