"""Operator 8: URL filters as a sort-merge range join, in DataFrame operations only.

A rule ``(host, path)`` fits its host and all subdomains where the url's path starts with the rule's. A url has one
canonical key for each of its host's suffixes: the labels reversed, then the path. In these keys a rule is the interval
of all keys that begin with its own, and the intervals of two rules are nested or apart. One sweep in key order meets
a rule's start, the urls in it and its end: the running count of starts less ends is the height of the stack of
active rules, and the rule on top for a url is the last one that started at the url's height.

Intervals never reach beyond one reversed host, so the sweep is partitioned by it. A host with many urls is dealt over
several partitions, each of which gets that host's rules.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), _UPPER, _LOW)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def _reversed(host: Column, labels: Column | None = None) -> Column:
    parts = F.reverse(F.split(host, r"\."))
    return F.array_join(parts if labels is None else F.slice(parts, F.lit(1), labels), ".")


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]]) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    quote = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(verdict, host, path)")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id_col, host, path, rule, verdict)`` for every row of ``pages``.

    ``rules`` has ``host``, ``path`` and ``verdict``; hosts are compared in lower case. The longest fitting rule (host and
    path together) wins and is named as host and path; of rules with one host and path the greatest verdict
    (block before allow) counts. Without a fitting rule ``rule`` is null and the verdict is ``default``. A url that is null
    or has no ``://`` has an empty host and path and fits rules of the empty host only. Repeated rows and null
    ids stay as they are; other columns of ``pages`` are not used.
    """
    spark = pages.sparkSession
    rules = rules.select(F.translate("host", _UPPER, _LOW).alias("host"), "path", "verdict").filter("host is not null and path is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = rules.withColumns({"site": _reversed(F.col("host")), "labels": F.size(F.split("host", r"\."))})
    deepest = rules.agg(F.max("labels")).first()[0] or 0
    urls = pages.select(F.col(id_col).alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    depths = F.sequence(F.lit(0), F.least(F.size(F.split("host", r"\.")), F.lit(deepest)))
    levels = urls.withColumn("depth", F.explode(depths)).withColumn("site", F.when(F.col("depth") > 0, _reversed(F.col("host"), F.col("depth"))))

    sites = rules.select("site").distinct()
    level_rows = levels.filter("depth > 0").join(sites, "site", "left_semi")
    sizes = level_rows.groupBy("site").agg(F.count("*").alias("urls"))
    total = sizes.agg(F.sum("urls")).first()[0] or 0
    share = max(1, total // int(spark.conf.get("spark.sql.shuffle.partitions")))
    salts = sizes.select("site", F.ceil(F.col("urls") / share).cast("int").alias("salts"))
    keyed = level_rows.join(salts, "site").withColumn("salt", F.pmod(F.xxhash64("id", "host", "path"), F.col("salts")))
    here = rules.join(salts, "site").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    rule = F.struct((F.char_length("host") + F.char_length("path")).alias("size"), F.concat("host", "path").alias("rule"), "verdict")
    start = F.col("path").cast("binary")
    no_rule = F.lit(None).cast("struct<size:int,rule:string,verdict:string>")
    at = lambda key, order, step: [key.alias("key"), F.lit(order).alias("at"), F.lit(step).alias("step")]
    begins = here.select("site", "salt", *at(start, 0, 1), rule.alias("opened"), F.lit(None).cast("struct<id:bigint,host:string,path:string>").alias("page"))
    ends = here.select("site", "salt", *at(F.concat(start, F.lit(b"\xff")), 2, -1), no_rule.alias("opened"), F.lit(None).cast("struct<id:bigint,host:string,path:string>").alias("page"))
    points = keyed.select("site", F.col("salt").cast("int").alias("salt"), *at(start, 1, 0), no_rule.alias("opened"), F.struct(F.col("id").cast("bigint").alias("id"), "host", "path").alias("page"))
    # without this exchange the join's by site alone would do for the windows, and a site's urls would be one task's
    events = begins.unionByName(points).unionByName(ends).repartition("site", "salt")

    sweep = Window.partitionBy("site", "salt").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    stacked = events.withColumn("height", F.sum("step").over(sweep))
    top = Window.partitionBy("site", "salt", "height").orderBy("key", "at").rowsBetween(Window.unboundedPreceding, 0)
    hit = stacked.withColumn("top", F.last("opened", ignorenulls=True).over(top)).filter("page is not null and height > 0").select("page.*", "top", F.lit(0).alias("rows"))

    every = levels.filter("depth = 0").select(F.col("id").cast("bigint").alias("id"), "host", "path", no_rule.alias("top"), F.lit(1).alias("rows"))
    best = every.unionByName(hit).groupBy("id", "host", "path").agg(F.max("top").alias("top"), F.sum("rows").cast("int").alias("rows"))
    best = best.withColumn("copy", F.explode(F.array_repeat(F.lit(0), F.col("rows"))))
    return best.select(F.col("id").alias(id_col), "host", "path", F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"))
