"""URL filters as a sort-merge range join, with DataFrame functions only.

A rule (host, path) fits its host and all subdomains if the url's path starts with the rule's path. With the labels of a
host reversed, `com.example` + `/` + path is a key under which every rule is an interval: all keys that start with its
own. A url is one point for each of its host's suffixes that is not longer than the longest rule host. Rules and points are
sorted together; a sweep carries the last rule passed, with the stack of rules it is nested in, and a point takes from
that stack the innermost rule that still contains it. Intervals of prefixes are nested or apart, so that is exact.

The sweep runs in blocks of the sorted order. Cuts come from a bounded sample of points (`cut_sample` keys) and include
a hash of the row, so one very common host spreads over many blocks; every block starts with the stack that was active
at its cut. Cuts change the balance, never a result.

Defined cases: a null url, or one without `://`, has empty host and path and fits no rule; repeated urls are judged each;
without rules every url gets the default verdict; among rules of one url the longest (host and path) wins, then the longer
host; of repeated rules with different verdicts, `block` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from packwise.llm.tables import ascii_lower, smallest

EDGE = "/"  # ends the host part of a key; no host holds it


def host_and_path(url: Column) -> tuple[Column, Column]:
    found = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(found > 0, F.substring(url, found + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return ascii_lower(host), path


def reversed_host(host: Column) -> Column:
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _stacks(rules: DataFrame) -> DataFrame:
    """(key, stack): each rule's key with all rules that contain it, the innermost (itself) first."""
    keyed = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # block > allow
    keyed = keyed.withColumn("key", F.concat(reversed_host(F.col("host")), F.lit(EDGE), "path"))
    own = keyed.select("key", F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "key", "host", "path", "verdict").alias("rule"))
    sizes = keyed.groupBy(F.length("key").alias("n")).count().select("n")  # lengths that occur
    # a rule contains this one if it equals one of its prefixes
    prefixes = own.select(F.col("key").alias("inner_key"), F.length("key").alias("size")).join(sizes, F.col("n") <= F.col("size"))
    prefixes = prefixes.select("inner_key", F.expr("substring(inner_key, 1, n)").alias("key"))
    outer = prefixes.join(own, "key").groupBy("inner_key").agg(F.collect_list("rule").alias("stack"))
    return outer.select(F.col("inner_key").alias("key"), F.reverse(F.array_sort("stack")).alias("stack"))


def _block_of(key: Column, salt: Column, cuts: list[tuple[str, int]]) -> Column:
    """Number of cuts at or below (key, salt), found in two steps."""
    point = F.struct(key.alias("key"), salt.alias("salt"))
    wide = max(1, int(len(cuts) ** 0.5))

    def below(some: list[tuple[str, int]]) -> Column:
        if not some:
            return F.lit(0)
        listed = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(s).cast("long").alias("salt")) for k, s in some])
        return F.size(F.filter(listed, lambda c: c <= point))

    groups = [cuts[i : i + wide] for i in range(0, len(cuts), wide)]
    coarse = below([g[0] for g in groups[1:]])
    fine = F.lit(0)
    for i, group in enumerate(groups):
        fine = F.when(F.col("coarse__") == i, i * wide + below(group)).otherwise(fine) if i else below(group)
    return coarse, fine


def sweep(points: DataFrame, rules: DataFrame, blocks: int, cut_sample: int = 20_000) -> DataFrame:
    """points (key, salt, ...) with `rule`: the innermost rule whose interval contains the key, or null."""
    stacks = _stacks(rules)
    sample = smallest(points.select("key", "salt"), [F.xxhash64("key", "salt"), "key", "salt"], cut_sample).collect()
    ordered = sorted({(r.key.encode(), r.salt, r.key) for r in sample})
    cuts = sorted({(ordered[i * len(ordered) // blocks][2], ordered[i * len(ordered) // blocks][1]) for i in range(1, blocks)} if ordered else set(), key=lambda c: (c[0].encode(), c[1]))

    def placed(df: DataFrame) -> DataFrame:
        coarse, fine = _block_of(F.col("key"), F.col("salt"), cuts)
        return df.withColumn("coarse__", coarse).withColumn("block__", fine).drop("coarse__")

    events = placed(stacks.withColumn("salt", F.lit(-(2**63)).cast("long")))
    names = [c for c in points.columns if c not in ("key", "salt")]
    empty = F.lit(None).cast(stacks.schema["stack"].dataType)
    # the stack at the start of a block is the last one of the blocks before it
    last = events.groupBy("block__").agg(F.max(F.struct("key", "stack")).alias("last"))
    every = points.sparkSession.range(len(cuts) + 1).select(F.col("id").cast("int").alias("block__"))  # one row for each cut
    before = Window.orderBy("block__").rowsBetween(Window.unboundedPreceding, -1)
    entry = every.join(last, "block__", "left").select("block__", F.last("last.stack", ignorenulls=True).over(before).alias("stack"))
    rows = placed(points).select("block__", "key", "salt", F.struct(*names).alias("row"), empty.alias("stack"), F.lit(1).alias("kind"))
    blank = F.lit(None).cast(rows.schema["row"].dataType)
    rows = rows.unionByName(events.select("block__", "key", "salt", blank.alias("row"), "stack", F.lit(0).alias("kind")))
    rows = rows.unionByName(entry.select("block__", F.lit("").alias("key"), F.lit(-(2**63)).cast("long").alias("salt"), blank.alias("row"), "stack", F.lit(-1).alias("kind")))
    along = Window.partitionBy("block__").orderBy("key", "kind", "salt").rowsBetween(Window.unboundedPreceding, 0)
    swept = rows.withColumn("active", F.last("stack", ignorenulls=True).over(along)).where("kind = 1")
    inside = F.filter("active", lambda r: F.startswith(F.col("key"), r["key"]))
    return swept.select("row.*", F.get(inside, F.lit(0)).alias("rule"))


def judged(urls: DataFrame, url: str, rules: DataFrame, *, default: str = "allow", blocks: int | None = None) -> DataFrame:
    """`doc` (all columns of urls), host, path, rule (host and path of the rule that decides, or null) and verdict."""
    spark = urls.sparkSession
    blocks = blocks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    depth = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    host, path = host_and_path(F.col(url))
    rows = urls.select(F.monotonically_increasing_id().alias("uid"), F.struct("*").alias("doc"), host.alias("host"), path.alias("path"))
    if not depth:
        return rows.select("doc", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."))) + 1
    suffixes = F.filter(F.sequence(F.lit(1), F.lit(depth)), lambda k: k <= labels)
    points = rows.withColumn("labels__", F.explode(suffixes))
    suffix = F.expr("substring_index(host, '.', -labels__)")
    points = points.select(F.concat(reversed_host(suffix), F.lit(EDGE), "path").alias("key"), F.xxhash64("uid").alias("salt"), "uid", "doc", "host", "path")
    best = sweep(points, rules, blocks).groupBy("uid").agg(F.first("doc").alias("doc"), F.first("host").alias("host"), F.first("path").alias("path"), F.max("rule").alias("rule"))
    return best.select(
        "doc", "host", "path", F.when(F.col("rule").isNotNull(), F.concat("rule.host", "rule.path")).alias("rule"), F.coalesce("rule.verdict", F.lit(default)).alias("verdict")
    )
