"""Rules of robots.txt as a table, and which addresses they let an agent fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _grouped_lines(files: DataFrame) -> DataFrame:
    """(host, line, key, value, starts, group) of files(host, text): agents named one after another begin one group; 0 is before any."""
    lines = files.select("host", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("line", "raw"))
    body = F.trim(F.regexp_extract("raw", "^([^#]*)", 1))
    keyed = lines.select("host", "line", F.lower(F.trim(F.regexp_extract(body, "^([^:]*):", 1))).alias("key"), F.trim(F.regexp_extract(body, "^[^:]*:(.*)$", 1)).alias("value")).where("key <> ''")
    own = Window.partitionBy("host").orderBy("line")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(own), F.lit("")) != "user-agent")
    return keyed.withColumn("starts", starts).withColumn("group", F.sum(F.col("starts").cast("int")).over(own))


def rules(files: DataFrame) -> DataFrame:
    """(host, group, agent, allow, pattern, line) of files(host, text): agents named one after another share a group's rules.

    A rule with an empty path that disallows says nothing and goes; groups without rules keep one row with a null pattern.
    """
    grouped = _grouped_lines(files)
    agents = grouped.where("key = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    paths = grouped.where((F.col("group") > 0) & F.col("key").isin("allow", "disallow") & ~((F.col("key") == "disallow") & (F.col("value") == "")))
    return agents.join(paths.select("host", "group", (F.col("key") == "allow").alias("allow"), F.col("value").alias("pattern"), "line"), ["host", "group"], "left").select("host", "group", "agent", "allow", "pattern", "line")


def crawl_delays(files: DataFrame) -> DataFrame:
    """(host, agent, delay): seconds that a group of files(host, text) asks its agents to wait; the last number of a group counts."""
    grouped = _grouped_lines(files)
    agents = grouped.where("key = 'user-agent'").select("host", "group", F.lower("value").alias("agent"))
    delays = grouped.where("group > 0 and key = 'crawl-delay'").select("host", "group", "line", F.col("value").try_cast("double").alias("delay")).where("delay is not null")
    return agents.join(delays.groupBy("host", "group").agg(F.max_by("delay", "line").alias("delay")), ["host", "group"]).select("host", "agent", "delay").distinct()


def sitemap_lines(files: DataFrame) -> DataFrame:
    """(host, loc): the sitemaps that files(host, text) name, wherever they stand."""
    return _grouped_lines(files).where("key = 'sitemap' and value <> ''").select("host", F.col("value").alias("loc")).distinct()


def path_regex(pattern: Column) -> Column:
    """A rule's path as a regular expression from the start of the path: * is anything, a last $ the end."""
    ends = F.endswith(pattern, F.lit("$"))
    bare = F.when(ends, F.expr("left(pattern, length(pattern) - 1)")).otherwise(pattern)
    quoted = F.regexp_replace(F.regexp_replace(bare, r"([\\.+?()\[\]{}^$|])", r"\\$1"), r"\*", ".*")
    return F.concat(F.lit("^"), quoted, F.when(ends, F.lit("$")).otherwise(F.lit("")))


def url_path(url: Column) -> Column:
    """Unquoted path and query."""
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    query = F.try_parse_url(url, F.lit("QUERY"))
    return F.concat(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path), F.when(query.isNotNull() & (query != ""), F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def allowed(urls: DataFrame, rule_table: DataFrame, agent: str) -> DataFrame:
    """urls(url, host) with allowed: the longest matching rule of the agent's group decides, allowing on a tie, and without one all is allowed.

    The group is that of the longest agent name that begins the agent's token or that it begins, else that of *.
    """
    token = agent.split("/", 1)[0].strip().lower()
    named = (F.col("agent") != "*") & (F.startswith(F.lit(token), F.col("agent")) | F.startswith(F.col("agent"), F.lit(token)))
    fit = rule_table.where(named | (F.col("agent") == "*")).withColumn("fit", F.when(F.col("agent") == "*", -1).otherwise(F.length("agent")))
    best = fit.groupBy("host").agg(F.min_by("group", F.struct(-F.col("fit"), F.col("group"))).alias("group"))
    own = rule_table.join(best, ["host", "group"], "left_semi").where("pattern is not null").select("host", "pattern", "allow").distinct()
    seen = urls.select("url", "host", url_path(F.col("url")).alias("path")).distinct()
    hits = seen.join(own.withColumn("regex", path_regex(F.col("pattern"))), "host").where(F.rlike("path", F.col("regex")))
    verdict = hits.groupBy("url", "host").agg(F.max_by("allow", F.struct(F.length("pattern"), "allow")).alias("verdict"))
    return urls.join(verdict, ["url", "host"], "left").withColumn("allowed", F.coalesce("verdict", F.lit(True))).drop("verdict")
