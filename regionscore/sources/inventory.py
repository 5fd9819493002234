"""What was read: bytes and digests of input files, their sidecars, and their format."""

from __future__ import annotations

from collections.abc import Mapping

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionscore.sources.splits import decoded

# Sources whose sidecar goes by another name.
SIDECAR_NAMES = {
    "bnetza_ladesaeulenregister": "bnetza_charging_register_nrw",
    "geofabrik_nrw_osm_roads": "geofabrik_nrw_osm_power",
}
REGISTER_COLUMNS = ("Bundesland", "Ladeeinrichtungs-ID")
PLANT_COLUMNS = (
    "id", "state", "lat", "lon", "name_bnetza", "company", "energy_source", "technology", "capacity_net_bnetza",
    "status", "voltage", "network_operator",
)


def _aliased(key: Column, names: Mapping[str, str]) -> Column:
    result = key
    for source, other in names.items():
        result = F.when(key == source, other).otherwise(result)
    return result


def _streamed_sha256(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the file at each path, in a task that reads it from its store a buffer at a time.

    Spark's own readers hold a file's bytes as one value, several times over, and none above 2 GB. These are the calls
    ``new DigestUtils("SHA-256").digestAsHex(path.getFileSystem(conf).open(path))`` of libraries that come with Spark; the
    stream closes at its end.
    """
    jvm = spark.sparkContext._jvm
    made, sql, utils = jvm.org.apache.spark.sql.catalyst.expressions, jvm.org.apache.spark.sql, jvm.org.apache.spark.util.Utils
    seq, text = jvm.PythonUtils.toSeq, sql.types.DataTypes.StringType

    def kind(name: str) -> JavaObject:
        return sql.types.ObjectType(utils.classForName(name, True, False))

    def new(name: str, *given: JavaObject) -> JavaObject:
        return made.objects.NewInstance(kind(name).cls(), seq(list(given)), seq([]), False, kind(name), jvm.scala.Option.empty())

    def call(on: JavaObject, method: str, result: JavaObject, *given: JavaObject) -> JavaObject:
        return made.objects.Invoke(on, method, result, seq(list(given)), seq([]), True, True, True)

    # the settings of this session go along with the tasks, as with a reader
    settings = jvm.org.apache.spark.util.SerializableConfiguration(spark._jsparkSession.sessionState().newHadoopConf())
    settings = made.Literal(settings, kind("org.apache.spark.util.SerializableConfiguration"))
    settings = call(settings, "value", kind("org.apache.hadoop.conf.Configuration"))
    name = call(sql.classic.ExpressionUtils.expression(path._jc), "toString", kind("java.lang.String"))
    file = new("org.apache.hadoop.fs.Path", name)
    store = call(file, "getFileSystem", kind("org.apache.hadoop.fs.FileSystem"), settings)
    stream = new("org.apache.commons.io.input.AutoCloseInputStream", call(store, "open", kind("java.io.InputStream"), file))
    digest = new("org.apache.commons.codec.digest.DigestUtils", made.Literal("SHA-256", kind("java.lang.String")))
    digits = call(digest, "digestAsHex", kind("java.lang.String"), stream)
    utf8 = utils.classForName("org.apache.spark.unsafe.types.UTF8String", True, False)
    result = made.objects.StaticInvoke(utf8, text, "fromString", seq([digits]), seq([]), True, True, True, jvm.scala.Option.empty())
    return Column(sql.classic.ExpressionUtils.column(result))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, bytes, sha256)`` of every file below a path; each file is hashed by one task, which holds a buffer of it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("length").alias("bytes"), _streamed_sha256(spark, F.col("path")).alias("sha256"))


def read_sidecars(spark: SparkSession, path: str) -> DataFrame:
    """``(name, provenance, provenance_sha256)`` of sidecar documents; a broken one is an error."""
    files = spark.read.format("binaryFile").load(path)
    text = F.decode("content", "UTF-8")
    parsed = F.try_parse_json(text)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    name = F.regexp_extract("path", r"([^/]+)\.json$", 1)
    return files.select(
        name.alias("name"),
        F.when(is_object, text)
        .otherwise(F.raise_error(F.concat(F.lit("provenance is not a JSON object: "), F.col("path"))))
        .alias("provenance"),
        F.sha2("content", 256).alias("provenance_sha256"),
    )


def inventory_inputs(
    consumed: DataFrame, digests: DataFrame, sidecars: DataFrame, names: Mapping[str, str] = SIDECAR_NAMES
) -> DataFrame:
    """One record per consumed ``(source_key, path)``; a consumed file without bytes is an error."""
    joined = consumed.join(digests, "path", "left").join(
        sidecars, _aliased(F.col("source_key"), names) == F.col("name"), "left"
    )
    missing = F.raise_error(F.concat(F.lit("consumed source is missing: "), F.col("path")))
    return joined.select(
        "source_key",
        F.col("path").alias("source_path"),
        F.when(F.col("bytes").isNull(), missing.cast("bigint")).otherwise(F.col("bytes")).alias("bytes"),
        "sha256",
        "provenance",
        "provenance_sha256",
    )


def cache_agreement(files: DataFrame, records: DataFrame) -> DataFrame:
    """``(dataset_id, agrees)``: bytes, digest, path, address and size limit all still match.

    ``files`` has ``dataset_id, target_path, url, bytes, sha256, expected_sha256, max_bytes``;
    ``records`` the stored ``dataset_id, target_path, registry_url, bytes, sha256``.
    """
    f, r = files.alias("f"), records.alias("r")
    joined = f.join(r, F.col("f.dataset_id") == F.col("r.dataset_id"), "left")
    pinned = F.nullif(F.trim(F.col("f.expected_sha256")), F.lit(""))
    agrees = (
        (F.col("f.target_path") == F.col("r.target_path"))
        & F.col("f.url").eqNullSafe(F.col("r.registry_url"))
        & (F.col("f.bytes") == F.col("r.bytes"))
        & (F.col("f.sha256") == F.col("r.sha256"))
        & (pinned.isNull() | (pinned == F.col("f.sha256")))
        & (F.col("f.bytes") <= F.col("f.max_bytes").cast("bigint"))
    )
    return joined.select(F.col("f.dataset_id").alias("dataset_id"), F.coalesce(agrees, F.lit(False)).alias("agrees"))


def format_report(files: DataFrame) -> DataFrame:
    """``(path, problem)`` of candidate files ``(path, dataset_id, content)``; NULL when sound.

    JSON must parse, GeoJSON must be a collection, CSV must have a header and a first row of the
    same width and the columns its reader needs. Whole contents are checked, file by file.
    """
    path, dataset = F.lower("path"), F.col("dataset_id")
    is_register = dataset == "bnetza_charging_register_nrw"
    mark = F.hex(F.substring("content", 1, 3)) == "EFBBBF"
    body = F.when(mark, F.expr("substring(content, 4)")).otherwise(F.col("content"))
    readable = F.when(is_register & ~mark, F.lit("")).otherwise(
        F.when(F.is_valid_utf8(body.cast("string")), F.lit("")).otherwise(F.lit(None))
    )
    text = F.when(is_register & ~mark, decoded(F.col("content"), "windows-1252")).otherwise(body.cast("string"))
    parsed = F.try_parse_json(text)
    collection = F.coalesce(
        (F.try_variant_get(parsed, "$.type", "string") == "FeatureCollection")
        & F.schema_of_variant(F.try_variant_get(parsed, "$.features", "variant")).startswith("ARRAY"),
        F.lit(False),
    )
    lines = F.split(text, r"\r?\n")
    skip = F.when(is_register, 10).otherwise(0)
    sep = F.when(is_register, ";").otherwise(",")

    def cells(line: Column) -> Column:
        quoted = F.regexp_replace(line, '"[^"]*"', "q")
        return F.when(line.isNotNull() & (line != ""), F.split(F.when(sep == ";", F.replace(quoted, F.lit(";"), F.lit("\x1f"))).otherwise(F.replace(quoted, F.lit(","), F.lit("\x1f"))), "\x1f"))

    header_line, first_line = F.get(lines, skip), F.get(lines, skip + 1)
    names = F.transform(
        F.split(F.when(sep == ";", F.replace(header_line, F.lit(";"), F.lit("\x1f"))).otherwise(F.replace(header_line, F.lit(","), F.lit("\x1f"))), "\x1f"),
        lambda c: F.btrim(c, F.lit('"')),
    )
    required = (
        F.when(is_register, F.array(*[F.lit(c) for c in REGISTER_COLUMNS]))
        .when(dataset == "opsd_conventional_power_plants_nrw", F.array(*[F.lit(c) for c in PLANT_COLUMNS]))
        .otherwise(F.array().cast("array<string>"))
    )
    width, row_width = F.size(cells(header_line)), F.size(cells(first_line))
    csv_problem = F.when(readable.isNull() | header_line.isNull() | cells(first_line).isNull(), "not readable CSV").when(
        (width < 2) | (row_width != width) | (F.size(F.array_except(required, names)) > 0), "invalid CSV header or data row"
    )
    problem = (
        F.when(path.endswith(".geojson"), F.when(parsed.isNull(), "not valid JSON").when(~collection, "not a FeatureCollection"))
        .when(path.endswith(".json"), F.when(parsed.isNull(), "not valid JSON"))
        .when(path.endswith(".csv"), csv_problem)
    )
    return files.select("path", "dataset_id", problem.alias("problem"))
