"""Scans and sinks of the engine's files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.text import blank_to_null, finite, points
from kerbline.plans.checkpoint import cut
from kerbline.plans.ranks import numbered

#: The feed's row tag and the columns that its CSV form must have.
ROW_TAG = "Closure"
REQUIRED = ("ID", "Latitude", "Longitude", "GeoPolyline")


def read_closures(spark: SparkSession, path: str) -> DataFrame:
    """The feed with every child tag as a text column."""
    return spark.read.format("xml").option("rowTag", ROW_TAG).option("inferSchema", "false").load(path)


def write_closures(rows: DataFrame, path: str, root: str = "Closures") -> None:
    rows.write.format("xml").option("rowTag", ROW_TAG).option("rootTag", root).save(path)


def typed_restrictions(closures: DataFrame) -> DataFrame:
    """Id, place, road names and polyline with a flag where it is malformed (blank or unreadable)."""
    path = points(F.col("GeoPolyline"))
    return closures.select(
        F.trim("Id").alias("restriction_id"), finite(F.col("Longitude")).alias("lon"), finite(F.col("Latitude")).alias("lat"),
        F.coalesce(blank_to_null(F.col("Road")), F.lit("")).alias("road"), path.alias("path"), path.isNull().alias("malformed"),
    )


def xml_problems(closures: DataFrame, required: list[str]) -> DataFrame:
    """(field, present, problem) of required tags; an empty feed lacks them all."""
    have = [f for f in required if f in closures.columns]
    counts = closures.agg(F.count("*").alias("n"), *[F.count_if(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) != "").alias(f) for f in have])
    rows = F.array(*[F.struct(F.lit(f).alias("field"), (F.col(f) if f in have else F.lit(0)).cast("long").alias("present")) for f in required])
    return counts.select("n", F.inline(rows)).select("field", "present", F.when(F.col("present") == 0, "missing").when(F.col("present") < F.col("n"), "incomplete").otherwise("ok").alias("state"))


def xml_roots(spark: SparkSession, path: str, root: str = "Closures") -> DataFrame:
    """(root, files, records, state) of the XML files below ``path``: ok, no records, or unexpected root.

    A file's root is its first tag; declarations, and comments of one line, are none. Files are read by lines, and each is one row before any shuffle.
    """
    text = F.regexp_replace("value", r"<!--.*?-->|<\?.*?\?>|<!DOCTYPE[^>]*>", "")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), text.alias("value"))
    tags = lines.select("file", "block", "at", F.regexp_extract("value", r"<([A-Za-z_][\w.:-]*)", 1).alias("tag"), F.regexp_count("value", F.lit(rf"<{ROW_TAG}[\s/>]")).alias("n"))
    files = tags.groupBy("file").agg(F.min_by(F.when(F.col("tag") != "", F.col("tag")), F.when(F.col("tag") != "", F.struct("block", "at"))).alias("root"), F.sum("n").alias("n"))
    out = files.groupBy("root").agg(F.count("*").alias("files"), F.sum("n").alias("records"))
    return out.withColumn("state", F.when(~F.col("root").eqNullSafe(F.lit(root)), "unexpected root").when(F.col("records") == 0, "no records").otherwise("ok"))


def read_csv_with_preamble(spark: SparkSession, path: str, required=REQUIRED) -> DataFrame:
    """Rows of CSV files whose header comes after other lines: in each file, the first line that holds the required names. Lines with another number
    of fields are flagged as ragged. Headers that differ give the columns of all. A file with text but without a header is an error.

    What comes to the driver is a row for each different header; what is broadcast, a place for each file."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")).alias("place"))
    lines = lines.where(F.trim("value") != "")
    bare = lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))
    named = F.lit(True)
    for r in required:
        named = named & F.array_contains(F.transform(F.split("value", ","), bare), r)
    heads = cut(lines.groupBy("file").agg(F.min(F.when(named, F.struct("place", "value"))).alias("h")).select(F.col("file").alias("_file"), F.col("h.place").alias("_from"), F.col("h.value").alias("_head")))
    if heads.isEmpty() or not heads.where("_head is null").isEmpty():
        raise ValueError(f"no header line holds {', '.join(required)}")
    body = lines.join(F.broadcast(heads), F.col("file") == F.col("_file")).where(F.col("place") > F.col("_from"))
    out = None
    for head in sorted(x[0] for x in heads.select("_head").distinct().collect()):
        names = [n.strip().strip('"') for n in head.split(",")]
        schema = ", ".join(f"`{n}` string" for n in [*names, "_more"])
        rows = body.where(F.col("_head") == head).select(F.from_csv("value", schema, {"mode": "PERMISSIVE"}).alias("r"), F.size(F.split("value", ",")).alias("w"))
        rows = rows.select(F.col("r.*"), ((F.col("r._more").isNotNull()) | F.col(f"r.`{names[-1]}`").isNull() & (F.col("w") < len(names))).alias("ragged")).drop("_more")
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out


def location_sidecar(closures: DataFrame) -> DataFrame:
    """Id and place names of records with any of them."""
    names = ["Road", "Name", "FromRoad", "ToRoad"]
    rows = closures.select(F.trim("Id").alias("restriction_id"), *[F.trim(F.coalesce(n, F.lit(""))).alias(n.lower()) for n in names])
    some = F.lit(False)
    for n in names:
        some = some | (F.col(n.lower()) != "")
    return rows.where(some)


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, bytes, sha256) of every file below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def checked_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each manifest row with whether its file is there and has its size and hash."""
    f = files.select("name", F.col("bytes").alias("found_bytes"), F.col("sha256").alias("found_sha256"))
    out = manifest.join(f, "name", "left")
    same = lambda a, b: F.coalesce(F.col(a) == F.col(b), F.lit(False))
    return out.select("name", F.col("found_bytes").isNotNull().alias("present"), same("bytes", "found_bytes").alias("size_ok"), same("sha256", "found_sha256").alias("hash_ok"))


IDENTITY = ["source", "url", "format", "name"]


def next_versions(manifest: DataFrame, fetched: DataFrame) -> DataFrame:
    """The rows to append: fetched payloads (identity, retrieved_at, sha256) that differ from the newest version of their identity, with whether
    there was one before."""
    newest = manifest.groupBy(*IDENTITY).agg(F.max(F.struct("retrieved_at", "sha256")).alias("n")).select(*IDENTITY, F.col("n.sha256").alias("before"))
    rows = fetched.join(newest, IDENTITY, "left").where(F.col("before").isNull() | (F.col("before") != F.col("sha256")))
    return rows.withColumn("content_changed_from_previous", F.when(F.col("before").isNull(), F.lit(None).cast("boolean")).otherwise(F.lit(True))).drop("before")


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None) -> None:
    """With a header; columns in the given order, else by name."""
    rows.select(*(columns or sorted(rows.columns))).write.option("header", True).csv(path)


def write_quoted_csv(rows: DataFrame, path: str) -> None:
    """Every value quoted, quotes doubled."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def review_rows(restrictions: DataFrame, candidates: DataFrame, threshold: float = 5.0) -> DataFrame:
    """One row per restriction for review: counts by signal, least distance, and ``HIGH=a;MEDIUM=b;LOW=c``."""
    from kerbline.operators.listing import at_threshold

    n = lambda c, v: F.count_if(F.col(c) == v)
    counted = at_threshold(candidates, threshold).groupBy("restriction_id").agg(
        F.count("*").alias("candidate_count"), n("signal", "direct_intersection").alias("direct_count"), n("signal", "proximity").alias("proximity_count"), n("signal", "point_fallback").alias("fallback_count"),
        F.min("distance_m").alias("minimum_distance_m"), n("confidence", "HIGH").alias("h"), n("confidence", "MEDIUM").alias("m"), n("confidence", "LOW").alias("l"))
    rows = restrictions.select("restriction_id").join(counted, "restriction_id", "left").na.fill(0)
    least = F.when(F.col("candidate_count") > 0, F.col("minimum_distance_m"))
    text = F.concat(F.lit("HIGH="), F.col("h").cast("string"), F.lit(";MEDIUM="), F.col("m").cast("string"), F.lit(";LOW="), F.col("l").cast("string"))
    return rows.withColumns({"minimum_distance_m": least, "confidence_distribution": text}).drop("h", "m", "l")


def as_json_lines(rows: DataFrame) -> DataFrame:
    """(value): each row as compact JSON with sorted keys and no nulls."""
    return rows.select(F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def write_json_artifact(rows: DataFrame, key: str, path: str) -> None:
    """JSON lines with sorted keys in the order of ``key``, which is unique: the files by name, one after the other, are the artifact."""
    ordered = rows.repartitionByRange(key).sortWithinPartitions(key)
    as_json_lines(ordered).write.text(path)


#: Lines, and then hashes, that one hash of the next level stands for.
HASHED = 1024


def artifact_hash(rows: DataFrame, key: str) -> DataFrame:
    """One row (n, sha256): a hash of the rows' JSON lines in the order of ``key``, whatever files or partitions they are in.

    A tree: the SHA-256 of each line, of the joined hashes of each 1,024 lines, of each 1,024 of these, and so for a third level; the last is over what
    that leaves, one hash for 2**30 lines. Of an empty table it is the hash of the empty text.
    """
    placed = numbered(rows.select(F.col(key).alias("_key"), F.struct(*sorted(rows.columns)).alias("line")), [F.col("_key")], "_at", 0)
    level = placed.select(F.col("_at").alias("at"), F.sha2(F.to_json("line"), 256).alias("h"))
    joined = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "h"))), lambda x: x["h"]), ""), 256)  # HASHED of them at most
    level = level.withColumn("n", F.lit(1).cast("long"))
    for _ in range(3):
        level = level.groupBy(F.expr(f"at div {HASHED}").alias("up")).agg(joined.alias("h"), F.sum("n").alias("n")).withColumnRenamed("up", "at")
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), joined.alias("sha256"))


def feature_collections(features: DataFrame) -> DataFrame:
    """(restriction_id, document): a GeoJSON collection for each case from features (restriction_id, pos, geometry, properties as JSON text)."""
    one = F.concat(F.lit('{"type":"Feature","geometry":'), "geometry", F.lit(',"properties":'), "properties", F.lit("}"))
    ordered = features.select("restriction_id", "pos", one.alias("f")).groupBy("restriction_id").agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("fs"))  # the candidates of one case
    body = F.array_join(F.transform("fs", lambda x: x["f"]), ",")
    return ordered.select("restriction_id", F.concat(F.lit('{"type":"FeatureCollection","features":['), body, F.lit("]}")).alias("document"))


def write_cells(rows: DataFrame, path: str) -> None:
    """One folder per cell, so that a reader of one cell reads nothing else."""
    rows.repartition("cell").write.partitionBy("cell").parquet(path)


def replaced(existing: DataFrame, loaded: DataFrame, by: str = "source_snapshot") -> DataFrame:
    """The table after a load: rows of the loaded snapshots are replaced as a whole."""
    return existing.join(loaded.select(by).distinct(), by, "left_anti").unionByName(loaded)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def assessment_inputs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Inputs from JSON files that hold an object or a list of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def routing_index(edges: DataFrame, barriers: DataFrame, schema_version: str = "routing-graph-v1", expected: str = "routing-graph-v1") -> tuple[DataFrame, DataFrame]:
    """(adjacency in both directions, distinct barrier segments)"""
    if schema_version != expected:
        raise ValueError(f"unsupported routing graph schema {schema_version}")
    back = edges.withColumns({"u": F.col("v"), "v": F.col("u")})
    return edges.unionByName(back), barriers.select("seg").distinct()
