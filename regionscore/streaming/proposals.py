"""Proposals as a stream: validated, assigned to a district, stored once per request id.

Uniqueness of a request id is permanent and belongs to accepted proposals only, so it is decided
against what is stored; a watermark would forget ids and would also swallow the retry of a
rejected proposal. A replayed batch writes to the same folder again and is compared with the
batches before it, so a restart neither loses nor doubles a row.

The ids and request ids in use are kept beside the proposals as bare keys, in folders by a hash of the key: a
batch reads the folders of its own keys, and now and then all batches so far are merged into one base, so the
files it reads do not grow with the number of batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from regionscore.functions.parsing import is_uuid
from regionscore.operators.region_index import RegionIndex
from regionscore.plans.scenario import validate_proposals
from regionscore.storage import materialize, path_exists

BUCKETS = 64
KEYS = "kind string, key string"

FEED_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("charging_points", T.IntegerType()),
        T.StructField("power_kw", T.DoubleType()),
        T.StructField("max_point_power_kw", T.DoubleType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("lat", T.DoubleType()),
    ]
)
STORED_SCHEMA = T.StructType(
    [*FEED_SCHEMA.fields, T.StructField("nuts_code", T.StringType()), T.StructField("status", T.StringType())]
)


def stored_proposals(spark: SparkSession, target: str) -> DataFrame:
    """Accepted proposals written so far, with their ``batch``."""
    whole = T.StructType([*STORED_SCHEMA.fields, T.StructField("batch", T.LongType())])
    if not path_exists(spark, f"{target}/accepted"):
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).parquet(f"{target}/accepted")


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def seen_keys(spark: SparkSession, target: str, batch: DataFrame, before_batch: int) -> DataFrame:
    """``(kind, key)`` of the stored ids and request ids that may be among those of ``batch``.

    Only the folders of the batch's buckets are listed: in the latest base, and in the batches since.
    """
    mine = _keys(batch).select("bucket").distinct().collect()  # at most BUCKETS numbers
    wanted = F.col("bucket").isin([r.bucket for r in mine] or [-1])
    base = max((n for n in _bases(spark, target) if n <= before_batch), default=None)
    found = spark.createDataFrame([], KEYS)
    if base is not None:
        found = found.unionByName(spark.read.schema(f"{KEYS}, bucket int").parquet(f"{target}/base/upto={base}").where(wanted).select("kind", "key"))
    if path_exists(spark, f"{target}/seen"):
        since = spark.read.schema(f"{KEYS}, batch long, bucket int").parquet(f"{target}/seen")
        since = since.where((F.col("batch") >= (base or 0)) & (F.col("batch") < before_batch) & wanted)
        found = found.unionByName(since.select("kind", "key"))
    return found


def _keys(rows: DataFrame) -> DataFrame:
    both = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("key")) for k, c in (("request", "request_id"), ("id", "id"))]))
    return rows.select(both.alias("k")).select("k.kind", "k.key").withColumn("bucket", _bucket("key"))


def _bases(spark: SparkSession, target: str) -> list[int]:
    """The merged bases that are complete."""
    folder = f"{target}/base"
    if not path_exists(spark, folder):
        return []
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    names = [f.getPath().getName() for f in listed]
    return [int(n.split("=")[1]) for n in names if n.startswith("upto=") and path_exists(spark, f"{folder}/{n}/_SUCCESS")]


def compact(spark: SparkSession, target: str, upto: int) -> None:
    """Merge the keys of all batches before ``upto`` into a base of one file a bucket.

    A base is read once it is complete; the one before stays until then, and batches are never changed.
    """
    base = max((n for n in _bases(spark, target) if n < upto), default=None)
    rows = spark.read.schema(f"{KEYS}, batch long, bucket int").parquet(f"{target}/seen").where((F.col("batch") >= (base or 0)) & (F.col("batch") < upto)).drop("batch")
    if base is not None:
        rows = rows.unionByName(spark.read.schema(f"{KEYS}, bucket int").parquet(f"{target}/base/upto={base}"))
    rows.distinct().repartition(BUCKETS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/base/upto={upto}")


def accept_batch(batch: DataFrame, stored: DataFrame, index: RegionIndex) -> tuple[DataFrame, DataFrame]:
    """``(new accepted proposals, rejected)`` of one batch; ``stored(kind, key)`` has the ids and request ids in use.

    As if the batch's valid rows came one by one in the order of ``created_at`` (then id, request id and content): a row is
    stored unless its request id or its id is in use by a stored row. A row that is itself rejected uses up neither,
    so a corrected retry still gets in, and so does the next request for an id. Every other valid row is rejected with its reason.

    All rows that come first for both their request and their id are settled at once, then what they
    leave over again, until nothing is left: one or two rounds, unless ids and requests are tangled on purpose. Firsts are
    least values, so a request delivered over and over is one row a task.
    """
    known = F.coalesce(is_uuid(F.col("request_id")), F.lit(False))
    valid, rejected = validate_proposals(batch.where(known), index)
    columns = valid.columns
    valid = materialize(valid.withColumn("row", F.monotonically_increasing_id()), "valid_proposals")
    order = F.struct("created_at", "id", "request_id", F.xxhash64(*columns).alias("content"), "row")
    old = stored.distinct()
    left = _without(_without(valid, old, "request", "request_id"), old, "id", "id").select("id", "request_id", order.alias("place"))
    left = materialize(left, "open_proposals")
    taken = valid.limit(0).select("row", "id", "request_id")
    while left.limit(1).count():
        by_request = left.groupBy("request_id").agg(F.min("place").alias("place"))
        by_id = left.groupBy("id").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
        won = materialize(by_request.select(F.col("place.row").alias("row"), F.col("place.id").alias("id"), "request_id").join(by_id, "row"), "first_proposals")
        taken = taken.unionByName(won)
        used = won.select(F.lit("request").alias("kind"), F.col("request_id").alias("key")).unionByName(won.select(F.lit("id").alias("kind"), F.col("id").alias("key")))
        left = materialize(_without(_without(left, used, "request", "request_id"), used, "id", "id"), "open_proposals")
    accepted = valid.join(taken.select("row"), "row", "left_semi").select(*columns)
    rest = valid.join(taken.select("row"), "row", "left_anti").select(*columns)
    requests = old.where("kind = 'request'").select("key").unionByName(taken.select(F.col("request_id").alias("key"))).distinct()
    marked = rest.join(requests.withColumn("used", F.lit(True)), F.col("request_id") == F.col("key"), "left")
    repeated = marked.withColumn("reason", F.when(F.col("used"), "duplicate_request").otherwise("duplicate_id")).drop("key", "used", "nuts_code", "status")
    return accepted, (
        rejected.unionByName(
            batch.where(~known).drop("nuts_code").withColumn("reason", F.lit("request_id")), allowMissingColumns=True
        ).unionByName(repeated, allowMissingColumns=True)
    )


def _without(rows: DataFrame, used: DataFrame, kind: str, column: str) -> DataFrame:
    keys = used.where(F.col("kind") == kind).select(F.col("key").alias("__key"))
    return rows.join(keys, F.col(column).eqNullSafe(F.col("__key")), "left_anti")


def start_proposal_feed(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    target: str,
    index: RegionIndex,
    *,
    schema: T.StructType = FEED_SCHEMA,
    once: bool = False,
    files_per_trigger: int | None = None,
    merge_every: int = 32,
) -> StreamingQuery:
    """Follow a folder of Parquet proposals; accepted rows go to ``target/accepted/batch=n``, their keys to ``target/seen``."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    feed = reader.parquet(path)

    def store(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        # Rows of this very batch may already be there from an attempt that was cut short.
        accepted, rejected = accept_batch(batch, seen_keys(session, target, batch, batch_id), index)
        columns = [f.name for f in STORED_SCHEMA.fields]
        accepted.select(*columns).write.mode("overwrite").parquet(f"{target}/accepted/batch={batch_id}")
        new = stored_proposals(session, target).where(F.col("batch") == batch_id)
        _keys(new).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/seen/batch={batch_id}")
        rejected.write.mode("overwrite").parquet(f"{target}/rejected/batch={batch_id}")
        if batch_id and batch_id % merge_every == 0:
            compact(session, target, batch_id)

    writer = feed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
