"""URL filters as a sort-merge range join, in DataFrame operations only.

A host becomes a key of its reversed labels, each followed by a dot (``m.example.com`` -> ``com.example.m.``), so a host
and its subdomains are one interval of keys. The rules' hosts nest or are apart; where an interval starts or ends, the
stack of rules active from there on is known: the rules of that host and of its ancestors. Rule boundaries and urls are
sorted together, and a sweep carries the last stack to each url; of the stack, the longest rule whose path the url's
path starts with decides.

The sweep runs apart for each first label. A label with many urls is cut into salts, so a hot label or host is spread
over many tasks: a url has one salt, the boundaries of the label are repeated for each. A salt has at least as many urls
as the label has boundaries, so these repeats never outnumber the urls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Urls of a salt: one part in SHARES of all, or PER where that is less.
SHARES, PER = 256, 1_000_000
#: Above every character of a key.
TOP = "\U0010ffff"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z as a-z; empty for null or no ``://``."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def lowered(h: Column) -> Column:
    """A-Z as a-z, all else as it is."""
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty for null or no ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(h: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(h, r"\.", -1)), "."), F.lit("."))


def _first(key: Column) -> Column:
    return F.substring_index(key, ".", 1)


def boundaries(rules: DataFrame) -> DataFrame:
    """(key, stack) where a host interval of the rules (host, path, action) starts or ends; stack: the rules active from there on."""
    keyed = rules.where("host is not null and path is not null").select(host_key(lowered(F.col("host"))).alias("key"), F.struct("host", "path", "action").alias("rule")).distinct()
    per_host = keyed.groupBy("key").agg(F.collect_list("rule").alias("own"))
    # a host's ancestors are the prefixes of its key that end at a dot
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.", -1)
    prefix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))
    above = per_host.select("key", F.explode(prefix).alias("up")).join(per_host.select(F.col("key").alias("up"), "own"), "up")
    stack = above.groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("stack"), F.flatten(F.collect_list(F.when(F.col("up") != F.col("key"), F.col("own")))).alias("rest")
    )
    return stack.select("key", "stack").unionByName(stack.select(F.concat("key", F.lit(TOP)).alias("key"), F.col("rest").alias("stack")))


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of each row of ``pages``, by ``rules`` (host, path, action: allow or block).

    A rule fits its host and all subdomains, if the url's path starts with the rule's. The longest rule (host and path
    together, then the path, then the text itself) wins; equal rules with both actions block. rule is its host and path,
    null if none fits, and then the verdict is ``default``. A null url, or one without ``://``, has an empty host and
    path, which no rule with a host fits. Rules with a null host or path are left out. Repeated rows stay repeated.
    Hosts are compared with A-Z as a-z and all else as it is. Very long urls are read whole; an empty table gives no rows;
    without rules every url has the default. Other columns are not read.
    """
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rows = rows.withColumn("key", host_key(F.col("host"))).withColumn("label", _first(F.col("key")))
    marks = boundaries(rules).withColumn("label", _first(F.col("key")))
    # labels with more urls than a salt should have: at most SHARES of them, or one for each PER urls
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).join(marks.groupBy("label").agg(F.count("*").alias("b")), "label", "left")
    total = rows.agg(F.count("*").alias("total"))
    per = F.greatest(F.coalesce("b", F.lit(0)), F.least(F.lit(PER), F.ceil(F.col("total") / SHARES)))
    hot = F.broadcast(counts.crossJoin(F.broadcast(total)).where(F.col("n") > per).select("label", F.ceil(F.col("n") / per).cast("int").alias("salts")))
    rows = rows.join(hot, "label", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("page_id", "host", "path"), "salts"), F.lit(0)).cast("int")).drop("salts")
    marks = marks.join(hot, "label", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0))))).drop("salts")
    both = marks.select(F.lit(None).cast(rows.schema["page_id"].dataType).alias("page_id"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "key", "label", "salt", "stack", F.lit(0).alias("kind"))
    both = both.unionByName(rows.withColumns({"stack": F.lit(None).cast(both.schema["stack"].dataType), "kind": F.lit(1)}))
    sweep = Window.partitionBy("label", "salt").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    fits = F.filter(F.col("active"), lambda r: F.col("path").startswith(r["path"]))
    rank = F.transform(
        fits, lambda r: F.struct((F.length(r["host"]) + F.length(r["path"])).alias("size"), F.length(r["path"]).alias("p"), F.concat(r["host"], r["path"]).alias("rule"), r["action"].alias("action"))
    )
    best = F.array_max(rank)
    return swept.select("page_id", "host", "path", best["rule"].alias("rule"), F.coalesce(best["action"], F.lit(default)).alias("verdict"))
