"""URL filters as a sort-merge range join, in DataFrame functions only.

A rule's canonical key is its host with the labels reversed, ``#`` (which no host has), and its path: ``com.example#/en/``
for example.com/en/. A url has such a key for each of its host's suffixes. A rule fits a url if its key begins the url's
key for the same suffix: that is an interval of keys, and such intervals nest or are disjoint. Interval starts, interval
ends and the urls' keys are sorted together and swept. The stack of active rules is linked: each rule knows the one it
is nested in, so a start puts its rule on top and an end puts back the one below, and the sweep needs the top alone. It
runs in range blocks; the top where a block begins is carried over from one row for each block. Equal keys of many urls
may be dealt to several blocks, so a common host or url makes no large block. Of a url's tops the longest rule wins.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule. Rules with an empty or null
host are ignored; a null path counts as ``/``. Of equal rules with unlike verdicts the later verdict by name wins (block).
Of rules of equal length the later by name wins. Repeated rows are judged each; a very long url is one row; tables and
rules may be empty; other columns of the input are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import partitions, written

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _after_scheme(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.expr("substring({0}, instr({0}, '://') + 3)".format("url"))).otherwise(F.lit(""))


def url_parts(pages: DataFrame) -> DataFrame:
    """page_id, host, path of (page_id, url)."""
    rest = F.coalesce(_after_scheme(F.col("url")), F.lit(""))
    return pages.select("page_id", "url").select(
        "page_id",
        F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower()).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
    )


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def _key(labels: Column, path: Column | str) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit("#"), path)


def nested_rules(rules: DataFrame) -> DataFrame:
    """key, top (n, rule, verdict) and below, the top of the rule that each distinct rule of (host, path, verdict) is nested in, or null."""
    named = rules.select(F.translate("host", _UPPER, _UPPER.lower()).alias("host"), F.coalesce("path", F.lit("/")).alias("path"), "verdict").filter("host <> ''")
    each = named.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rule = F.concat("host", "path")
    each = each.select(_key(_labels(F.col("host")), "path").alias("key"), "path", F.struct(F.length(rule).alias("n"), rule.alias("rule"), "verdict").alias("top"))
    shorter = F.explode(F.filter(F.sequence(F.lit(0), F.length("path")), lambda i: i < F.length("path")))
    begins = each.select("key", "path", shorter.alias("i")).select("key", "i", F.expr("substring(key, 1, length(key) - length(path) + i)").alias("begin"))
    below = begins.join(each.select(F.col("key").alias("begin"), F.col("top").alias("below")), "begin").groupBy("key").agg(F.max_by("below", "i").alias("below"))
    return each.select("key", "top").join(below, "key", "left")


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for pages (page_id, url) under rules (host, path, verdict)."""
    parts = url_parts(pages)
    known = nested_rules(rules)
    none = F.lit(None).cast("string")
    labels = _labels(F.col("host"))
    of_urls = parts.filter("host <> ''").select("host", "path").distinct().select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")))).alias("key"))
    on_top = F.struct(F.col("top").alias("is"))  # a struct around it, so that nothing on top differs from no change
    events = (
        known.select(F.col("key").cast("binary").alias("pos"), F.lit(1).alias("turn"), on_top.alias("change"), none.alias("host"), none.alias("path"))
        .unionAll(known.select(F.concat(F.col("key").cast("binary"), F.lit(b"\xff")), F.lit(0), F.struct(F.col("below").alias("is")), none, none))
        .unionAll(of_urls.select(F.col("key").cast("binary"), F.lit(2), F.lit(None).cast(known.select(on_top.alias("t")).schema["t"].dataType), "host", "path"))
    )
    blocks = written(events.withColumn("salt", F.xxhash64("host", "path")).repartitionByRange(partitions(pages.sparkSession), "pos", "turn", "salt").withColumn("block", F.spark_partition_id()), "sweep")
    order = F.struct("pos", "turn")
    at_end = blocks.groupBy("block").agg(F.max_by("change", F.when(F.col("change").isNotNull(), order)).alias("last"))
    # one row for each block of the sweep: no more than there are shuffle partitions
    carried = at_end.select("block", F.last("last", ignorenulls=True).over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    sweep = Window.partitionBy("block").orderBy("pos", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = blocks.select("block", "turn", "host", "path", F.last("change", ignorenulls=True).over(sweep).alias("now")).filter("turn = 2").join(F.broadcast(carried), "block")
    tops = swept.select("host", "path", F.coalesce("now", "carried")["is"].alias("top")).filter("top is not null")
    best = tops.groupBy("host", "path").agg(F.max("top").alias("best"))
    # one row for each distinct url with a rule; AQE splits a url that is a large share of the pages
    return parts.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
