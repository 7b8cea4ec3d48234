"""URL filters by a sorted sweep over reversed-host keys; DataFrame functions only.

A rule (host, path) becomes the interval of all keys that begin with "reversed host, 0 byte, path". A URL becomes one
key for each of its host's suffixes (a few), so that subdomains fit too. Rules and keys are range-sorted together; the
sweep carries the top of the stack of open rules, and where a rule's interval ends its enclosing rule is on top again.

Defined results: null or scheme-less URLs have an empty host and path and get the default verdict; repeated URLs are
swept once; of several fitting rules the one with the most characters in host and path wins, then the longer host, then
"block". Repeated rules count once (a block beats an allow with equal host and path). An empty rule table gives the
default verdict to all. Other columns of the pages are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quakelens.llm.common import staged

#: (verdict, host, path) of the filter's own rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT_VERDICT = "allow"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_host_path(pages: DataFrame) -> DataFrame:
    """page_id, host and path of every page."""
    rest = F.expr("if(instr(__u, '://') > 0, substring(__u, instr(__u, '://') + 3), '')")
    return (
        pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("__u"))
        .select("page_id", rest.alias("__r"))
        .select(
            "page_id",
            F.translate(F.regexp_extract("__r", r"(?s)^([^/?#]*)", 1), _UPPER, _LOWER).alias("host"),
            F.regexp_extract("__r", r"(?s)^[^/?#]*([^?#]*)", 1).alias("path"),
        )
    )


def _reversed(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _key(host: Column, path: Column) -> Column:
    """Reversed host, a 0 byte, the path: bytes, which Spark sorts as unsigned."""
    return F.encode(F.concat(_reversed(host), F.lit("\u0000"), path), "utf-8")


def rule_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def _boundaries(rules: DataFrame) -> DataFrame:
    """Each rule's start, with the rule on top, and its end, with the enclosing rule on top (or none)."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    top = F.struct(F.col("host"), F.col("path"), F.col("verdict"))
    prefixes = one.filter(F.length("path") > 0).select(
        "host", F.col("path").alias("own"), F.explode(F.expr("transform(sequence(0, length(path) - 1), n -> substring(path, 1, n))")).alias("path")
    )
    parents = prefixes.join(one, ["host", "path"]).groupBy("host", "own").agg(F.max_by(top, F.length("path")).alias("parent"))
    nested = one.alias("r").join(parents.alias("p"), (F.col("r.host") == F.col("p.host")) & (F.col("r.path") == F.col("p.own")), "left")
    rule = F.struct(F.col("r.host").alias("host"), F.col("r.path").alias("path"), F.col("r.verdict").alias("verdict"))
    key = _key(F.col("r.host"), F.col("r.path"))
    # No byte of UTF-8 is FF, so key + FF follows every key that begins with it. Inner rules end first: their keys are longer.
    return nested.select(
        F.explode(
            F.array(
                F.struct(key.alias("k"), F.lit(0).alias("kind"), F.struct(rule.alias("rule")).alias("top")),
                F.struct(F.concat(key, F.lit(b"\xff")).alias("k"), F.lit(0).alias("kind"), F.struct(F.col("p.parent").alias("rule")).alias("top")),
            )
        ).alias("e")
    ).select("e.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, partitions: int | None = None) -> DataFrame:
    """page_id, host, path, rule (host and path of the rule that decides, else null) and verdict of every page."""
    spark = pages.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = with_host_path(pages)
    addresses = parts.select("host", "path").distinct()
    # One key for each suffix of the host that some rule names.
    labels = F.split("host", r"\.")
    suffixes = addresses.select(
        "host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))).alias("suffix")
    )
    named = rules.select(F.col("host").alias("suffix")).distinct()
    probes = suffixes.join(named, "suffix", "left_semi").select(_key(F.col("suffix"), F.col("path")).alias("k"), "host", "path")
    events = _boundaries(rules).withColumns({"host": F.lit(None).cast("string"), "path": F.lit(None).cast("string")}).unionByName(
        probes.withColumns({"kind": F.lit(1), "top": F.lit(None).cast("struct<rule:struct<host:string,path:string,verdict:string>>")})
    )
    # Written once: range bounds come from a sample, and a second exchange would draw others.
    dealt = staged(events.repartitionByRange(n, "k").withColumn("part", F.spark_partition_id()), "urls")
    ordered = Window.partitionBy("part").orderBy("k", "kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = dealt.withColumn("top", F.last("top", ignorenulls=True).over(ordered))
    # What is on top where a range begins: the last top of the ranges before it. A row for each range at most.
    ends = dealt.filter("kind = 0").groupBy("part").agg(F.max_by("top", "k").alias("carried"))
    ranges = spark.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
    before = ranges.select("part", F.last("carried", ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    best = (
        swept.filter("kind = 1")
        .join(F.broadcast(before), "part", "left")
        .select("host", "path", F.coalesce("top", "carried").getField("rule").alias("rule"))
        .filter("rule is not null")
        .groupBy("host", "path")
        .agg(F.max_by("rule", F.struct(F.length("rule.host") + F.length("rule.path"), F.length("rule.host"))).alias("rule"))
    )
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.concat("rule.host", "rule.path").alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict")
    )


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, rule_frame(spark, RULES))


_URL_SQL = "CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
ORACLE = f"""
WITH r AS (SELECT page_id, {_URL_SQL} AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rh, rp) AS (VALUES {", ".join(map(str, RULES))}),
m AS (SELECT page_id, max_by(rh || rp, length(rh || rp)) AS rule, max_by(verdict, length(rh || rp)) AS verdict
      FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
