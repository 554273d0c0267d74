"""URL filters: a sort-merge range join of URLs with nested host and path rules.

A host turns into a key with its labels reversed (``com.example.www.``), so that a rule's host
and all its subdomains are one interval of keys; so are all paths with a prefix. Two sorted
sweeps place each URL. The first goes over host keys and finds the innermost rule host. The
second goes over paths within that host, whose rules include those inherited from the hosts
around it, and finds the active prefixes. Interval starts and ends carry the stack of what is
active after them, so a URL reads the last event before it. Sweeps are windows over URLs and
events together. URLs are dealt by the last two labels of their host, as a rule's host of two
labels or more shares them with the hosts it fits; intervals of other labels open and close
between a part's keys and leave nothing behind, so a part gets the events of its labels and of the
hosts of one label alone. Labels with many URLs are spread over parts by a hash of the row, so a hot
host is no hot partition. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def end_of(key):
    """What sorts behind every key that starts with this one: FF is behind every UTF-8 byte."""
    return F.concat(key, F.unhex(F.lit("FF")))


def bytes_of(column):
    return F.encode(column, "UTF-8")


def host_key(host):
    return bytes_of(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def small_letters(column):
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url):
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return small_letters(F.regexp_extract(rest(url), r"^[^/?#]*", 0))


def url_path(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(rest(url), r"^[^/?#]*([^?#]*)", 1)


def rest(url):
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise(F.lit(""))


def cleaned(rules: DataFrame) -> DataFrame:
    """One row per host and path; of a blocking and an allowing rule the blocking one stays."""
    return (rules.select(small_letters(F.col("host")).alias("host"), F.coalesce(F.col("path"), F.lit("")).alias("path"),
                         F.col("verdict"))
            .where(F.col("host").isNotNull() & (F.col("host") != "") & F.col("verdict").isNotNull())
            .groupBy("host", "path").agg(F.max("verdict").alias("verdict")))


def host_events(rules: DataFrame) -> DataFrame:
    """Starts and ends of host intervals, each with the innermost host that is active after it."""
    hosts = rules.select("host").distinct()
    labels = F.split(F.col("host"), r"\.")
    above = (hosts.select("host", F.posexplode(labels).alias("skip", "label"))
             .select("host", F.array_join(F.slice(labels, F.col("skip") + 1, F.size(labels)), ".").alias("outer"), "skip"))
    around = above.where("skip > 0").join(hosts.select(F.col("host").alias("outer")), "outer")
    # the stack: all hosts around, outermost first
    stacks = around.groupBy("host").agg(F.sort_array(F.collect_list(F.struct((-F.col("skip")).alias("o"), "outer"))).alias("stack"))
    full = hosts.join(stacks, "host", "left")
    key = host_key(F.col("host"))
    outer = F.when(F.size("stack") > 0, F.element_at(F.col("stack.outer"), -1))
    return (full.select("host", key.alias("host_key"), F.col("host").alias("active"))
            .unionByName(full.select("host", end_of(key).alias("host_key"), outer.alias("active"))))


def path_events(rules: DataFrame) -> DataFrame:
    """Per host with rules, its own and inherited path intervals, each event with the stack of active rules."""
    hosts = rules.select("host").distinct()
    labels = F.split(F.col("host"), r"\.")
    above = (hosts.select("host", F.explode(F.sequence(F.lit(0), F.size(labels) - 1)).alias("skip"))
             .select("host", F.array_join(F.slice(labels, F.col("skip") + 1, F.size(labels)), ".").alias("outer")))
    own = rules.select(F.col("host").alias("outer"), "path", "verdict")
    # of equal paths the longest host's rule stands
    best = F.max(F.struct(F.length("outer").alias("n"), "outer", "verdict")).alias("best")
    local = (above.join(own, "outer").groupBy("host", "path").agg(best)
             .select("host", "path", F.struct((F.length("path") + F.length("best.outer")).alias("n"),
                                              F.length("best.outer").alias("h"),
                                              F.concat("best.outer", "path").alias("rule"),
                                              F.col("best.verdict").alias("verdict")).alias("entry")))
    cuts = local.select("host", "path", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("n"))
    inner = cuts.select("host", "path", F.substring("path", 1, F.col("n")).alias("outer_path"), "n")
    stack = (inner.join(local.select("host", F.col("path").alias("outer_path"), "entry"), ["host", "outer_path"])
             .groupBy("host", "path").agg(F.sort_array(F.collect_list(F.struct("n", "entry"))).alias("stack")))
    key = bytes_of(F.col("path"))
    entries = F.col("stack.entry")
    return (stack.select("host", key.alias("path_key"), entries.alias("stack"))
            .unionByName(stack.select("host", end_of(key).alias("path_key"),
                                      F.slice(entries, 1, F.size("stack") - 1).alias("stack"))))


def group_of(host, parts: int):
    """Group of the last two labels of a host (of all, where there are fewer)."""
    labels = F.split(host, r"\.")
    last = F.when(F.size(labels) > 2, F.slice(labels, -2, 2)).otherwise(labels)
    return F.pmod(F.xxhash64(F.array_join(last, ".")), F.lit(parts)).cast("int")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               default: str = "allow", parts: int | None = None) -> DataFrame:
    """Per row of ``pages``: the id, host, path, rule (``host/path``, or null) and verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains if the path
    starts with the rule's; the longest rule text wins, of equal ones the longest host, and
    ``default`` holds where none fits. Rules with a null or empty host are left out, a null
    path is an empty one. A null URL, or one without ``://``, has an empty host and path and
    fits no rule. Repeated rows and null ids are judged one by one.

    ``parts`` (shuffle partitions by default) is the number of groups of labels. A group with more
    than twice its share of the URLs is cut further, which gives half as many parts again at most. URLs
    are dealt by hashes, so a task that runs again deals alike; rows equal in id and URL go together.
    """
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = cleaned(rules)
    url = F.col("url")
    urls = (pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
            .select("id", url_host(url).alias("host"), url_path(url).alias("path"), F.xxhash64("id", "url").alias("row"))
            .withColumn("label_group", group_of(F.col("host"), parts)))
    whole = Window.partitionBy(F.lit(0))
    salts = F.ceil(F.col("count") * parts / (2 * F.sum("count").over(whole))).cast("int")
    # one row per group: at most ``parts``
    groups = F.broadcast(urls.groupBy("label_group").count().select("label_group", salts.alias("salts")))
    urls = urls.join(groups, "label_group").select(
        "id", "host", "path", "label_group", F.pmod("row", "salts").cast("int").alias("salt"), F.lit(2).alias("kind"),
        host_key(F.col("host")).alias("host_key"), bytes_of(F.col("path")).alias("path_key"))

    def dealt(events):
        single = F.size(F.split("host", r"\.")) == 1
        near = events.where(~single).withColumn("label_group", group_of(F.col("host"), parts))
        everywhere = events.where(single).withColumn("label_group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return near.unionByName(everywhere).join(groups, "label_group").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    hosts = dealt(host_events(own)).select("label_group", "salt", F.lit(0).alias("kind"), "host_key", "active")
    paths = dealt(path_events(own)).select("label_group", "salt", F.lit(1).alias("kind"), F.col("host").alias("path_host"),
                                           "path_key", "stack")
    both = urls.unionByName(hosts, allowMissingColumns=True).unionByName(paths, allowMissingColumns=True)

    so_far = (Window.unboundedPreceding, Window.currentRow)
    # events are wrapped in structs, so that a null (nothing active) is told from no event
    by_host = Window.partitionBy("label_group", "salt").orderBy(F.col("host_key").asc_nulls_first(), "kind").rowsBetween(*so_far)
    placed = both.withColumn("place", F.last(F.when(F.col("kind") == 0, F.struct("active")), ignorenulls=True).over(by_host))
    group = F.when(F.col("kind") == 1, F.col("path_host")).when(F.col("kind") == 2, F.col("place.active"))
    keyed = placed.where("kind > 0").withColumn("group", group)
    by_path = (Window.partitionBy("label_group", "salt").orderBy(F.col("group").asc_nulls_first(), "path_key", "kind").rowsBetween(*so_far))
    event = F.when(F.col("kind") == 1, F.struct(F.col("group").alias("of"), "stack"))
    swept = keyed.withColumn("event", F.last(event, ignorenulls=True).over(by_path)).where("kind = 2")
    winner = F.when(F.col("event.of") == F.col("group"), F.array_max("event.stack"))
    return swept.select(F.col("id").alias(id_col), "host", "path", winner.alias("winner")).select(
        id_col, "host", "path", F.col("winner.rule").alias("rule"),
        F.coalesce(F.col("winner.verdict"), F.lit(default)).alias("verdict"))
