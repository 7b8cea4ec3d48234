"""Readers of recorded incidents: facts, topology, changes, alerts, manifests, labels, knowledge."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quakelens.sources import schemas

ALERTS = "received_at timestamp, payload struct<alerts: array<struct<status: string, labels: map<string, string>>>>"
LABEL = "scenario_id string, run_id string, bundle_id string, split string, target_service string, fault_class string, fault_onset timestamp, fault_cleared timestamp, canary string"


def _with_bundle(df: DataFrame) -> DataFrame:
    """The name of the folder that a row's file stands in."""
    return df.withColumn("bundle_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def read_facts(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Metrics, traces or logs of all bundles under a folder, by their declared schema."""
    contract = {"metrics": schemas.METRICS, "traces": schemas.TRACES, "logs": schemas.LOGS}[kind]
    return _with_bundle(spark.read.schema(contract).parquet(f"{root}/*/{kind}.parquet")).select("bundle_id", *contract.names)


def read_topology(spark: SparkSession, root: str, files: str = "topology.json") -> DataFrame:
    """Call edges of all bundles; an edge without ends or with a missing or negative rate stops the job, and so does an
    unknown field of a file or an edge: who writes them has changed the format. A file is read whole, one to a bundle."""
    text = _with_bundle(spark.read.text(f"{root}/*/{files}", wholetext=True))
    parsed = text.select(
        "bundle_id", F.from_json("value", schemas.TOPOLOGY, {"mode": "FAILFAST"}).alias("file"), F.json_object_keys("value").alias("fields"),
        F.transform(F.from_json(F.get_json_object("value", "$.edges"), "array<map<string,string>>"), lambda e: F.map_keys(e)).alias("edge_fields"),
    )
    named = lambda known: F.array(*(F.lit(n) for n in known))
    unknown = F.array_union(F.array_except("fields", named(schemas.TOPOLOGY.names)), F.array_except(F.flatten("edge_fields"), named([*schemas.EDGE.names, "error_ratio"])))
    stop = F.raise_error(F.concat(F.lit("unknown fields in a topology file: "), F.array_join(unknown, ", "))).cast("string")
    whole = parsed.withColumn("bundle_id", F.when(F.size(unknown) > 0, stop).otherwise(F.col("bundle_id")))
    edges = whole.select("bundle_id", F.inline("file.edges"))
    bad = F.col("client").isNull() | F.col("server").isNull() | ~F.coalesce(F.col("requests_per_second") >= 0, F.lit(False)) | ~F.coalesce(F.col("failures_per_second") >= 0, F.lit(False))
    rate = F.when(bad, F.raise_error(F.lit("an edge is malformed")).cast("double")).otherwise(F.col("requests_per_second"))
    ratio = F.when(rate > 0, F.col("failures_per_second") / rate).otherwise(0.0)  # what the file says isn't trusted
    return edges.select("bundle_id", "client", "server", rate.alias("requests_per_second"), "failures_per_second", F.round(ratio, 6).alias("error_ratio"))


def _unseen(spark: SparkSession, root: str) -> DataFrame:
    """Files that Spark's readers pass over: empty ones, and those whose names begin with _ or a dot (without a digest)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/*/*")
    found = []
    for status in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []:
        name, empty = status.getPath().getName(), status.getLen() == 0
        if status.isFile() and (empty or name[0] in "_.") and not name.endswith(".crc"):
            found.append((status.getPath().getParent().getName(), name, status.getLen(), hashlib.sha256().hexdigest() if empty else None))
    return spark.createDataFrame(found, "bundle_id string, name string, bytes long, sha256 string")


def bundle_files(spark: SparkSession, root: str) -> DataFrame:
    """Name, size and SHA-256 of every file in the bundles' folders under a root; each file is read whole by one task.

    Names come from a listing on the driver, as for every read; checksum files of the file system itself are left out.
    """
    found = _with_bundle(spark.read.format("binaryFile").load(f"{root}/*/*"))
    read = found.select("bundle_id", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return read.unionByName(_unseen(spark, root))


def manifest_files(spark: SparkSession, root: str, files: str = "manifest.json") -> DataFrame:
    """The files that each bundle's manifest lists; a row without a name for one that lists none."""
    read = _with_bundle(spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(f"{root}/*/{files}").withColumnRenamed("bundle_id", "__own"))
    return read.select("bundle_id", F.explode_outer("files").alias("f")).select("bundle_id", "f.name", "f.bytes", "f.sha256")


def read_changes(spark: SparkSession, root: str) -> DataFrame:
    """The change log of all bundles."""
    return _with_bundle(spark.read.schema(schemas.CHANGE).option("multiLine", True).json(f"{root}/*/changes.json")).select("bundle_id", *schemas.CHANGE.names)


def alert_deliveries(lines: DataFrame) -> DataFrame:
    """One row for each alert of a delivery, with the delivery's summary; works on streams too. lines: ALERTS columns."""
    alerts = F.coalesce("payload.alerts", F.array().cast("array<struct<status:string,labels:map<string,string>>>"))
    names = F.transform(alerts, lambda a: F.concat(F.coalesce(a["labels"]["alertname"], F.lit("unnamed")), F.lit("["), F.coalesce(a["status"], F.lit("unknown")), F.lit("]")))
    summary = F.concat(F.size(alerts).cast("string"), F.lit(" alert(s): "), F.array_join(names, ", "))
    return lines.select("received_at", summary.alias("summary"), F.explode_outer(alerts).alias("a")).select("received_at", "summary", "a.status", "a.labels")


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Alert deliveries from JSON lines."""
    return alert_deliveries(spark.read.schema(ALERTS).json(path))


def library_index(spark: SparkSession, root: str, files: str = "manifest.json") -> DataFrame:
    """A row for each recorded bundle with the row counts of its files."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(f"{root}/*/{files}").select(
        "bundle_id", "run_id", "recorded_at", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "alert_fired_at", F.map_from_entries(F.transform("files", lambda f: F.struct(f["name"], f["rows"]))).alias("rows")
    )


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """Labels by bundle, scenario and run."""
    return spark.read.schema(LABEL).option("multiLine", True).json(f"{root}/*/*.json")


def read_lines(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """JSON lines; a bad line stops the job, or is left out."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def bad_lines(spark: SparkSession, path: str, schema: str) -> int:
    """How many lines don't follow the schema."""
    parsed = spark.read.text(path).select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.filter("r._bad is not null").count()


def read_runbooks(spark: SparkSession, path: str) -> DataFrame:
    """Runbooks from text files with front matter between --- lines (id, title, covers, symptoms) and a body."""
    whole = spark.read.text(path, wholetext=True)
    head, body = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---\n", 1), F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n", "")
    field = lambda n: F.trim(F.regexp_extract(head, rf"(?m)^{n}:\s*(.*)$", 1))
    items = lambda n: F.filter(F.transform(F.split(F.regexp_replace(field(n), r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return whole.select(field("id").alias("runbook_id"), field("title").alias("title"), items("covers").alias("covers"), items("symptoms").alias("symptoms"), body.alias("body"))
