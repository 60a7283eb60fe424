"""URL rules matched through host-suffix and path-prefix expressions.

Each distinct URL is expanded into the expressions ``host-suffix`` + ``path-prefix``
of the shapes that rules have: a shape is a number of host labels and a length of
the path, so a URL has at most one expression a shape, however long it is.
Expressions meet the rules in an equi-join on a short prefix of their SHA-256; the
full digest then confirms the match, and the longest rule that fits decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import keep, look_up

PREFIX_HEX = 8  # hexadecimal digits of the digest that are joined on: 4 bytes
SMALL_RULES = 100_000  # rules that may be broadcast: at most 20 MB
SALTS = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is no ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/[^?#]*)", 1), F.lit(""))


def labels_of(host: Column) -> Column:
    """Number of the labels between the dots of a host."""
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def last_labels(host: Column, n: Column) -> Column:
    """The last ``n`` labels of a host."""
    return F.call_function("substring_index", host, F.lit("."), -n)


def _joined(suffix: Column, prefix: Column) -> Column:
    """An expression; the separator keeps "a" + "b/" apart from "ab" + "/"."""
    return F.concat(suffix, F.lit("\0"), prefix)


def _digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages(page_id, url)`` by ``rules(host, path, action)``: ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains where the path starts with its own.
    Of the fitting rules the longest (host and path together) wins; between
    equal rules with two actions, block.  URLs that no rule fits, null URLs and
    URLs without ``://`` get ``default``.  Rows that repeat are judged alike and
    all returned; null page_ids too.  Rules with a null part never fit.  An empty
    table gives an empty one, and without rules all get ``default``.  Other
    columns of ``pages`` are not read.
    """
    rules = rules.dropna(subset=["host", "path", "action"]).select(
        "host", "path", "action", F.struct(labels_of(F.col("host")).alias("labels"), F.length("path").alias("length")).alias("shape")
    )
    counted = rules.agg(F.count("*").alias("n"), F.collect_set("shape").alias("shapes"))
    shapes = F.broadcast(counted.select("shapes"))  # one row: depths of hosts x lengths of paths, whatever the number of rules
    many = counted.first()["n"]
    digest = _digest(_joined(F.col("host"), F.col("path")))
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))
    rules = rules.select(F.concat("host", "path").alias("rule"), "action", digest.alias("full"), F.substring(digest, 1, PREFIX_HEX).alias("short"))

    urls = keep(pages.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("pages")), "urls")
    known = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    known = known.withColumns({"n_labels": labels_of(F.col("host")), "n_path": F.length("path")}).join(shapes)
    fitting = F.filter("shapes", lambda s: (s["labels"] <= F.col("n_labels")) & (s["length"] <= F.col("n_path")))
    expressions = known.select("url", "host", "path", F.explode(fitting).alias("shape"))
    expression = _joined(last_labels(F.col("host"), F.col("shape.labels")), F.substring(F.col("path"), F.lit(1), F.col("shape.length")))
    expressions = expressions.select("url", _digest(expression).alias("of_url"))
    expressions = expressions.select("url", "of_url", F.substring("of_url", 1, PREFIX_HEX).alias("short"))
    if many <= SMALL_RULES:
        met = expressions.join(F.broadcast(rules), "short")
    else:  # many rules: shuffle, with common expressions (a top-level domain) dealt over salts
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = expressions.withColumn("salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    winner = F.max(F.struct(F.length("rule").alias("length"), "action", "rule")).alias("best")
    found = met.where("of_url = full").groupBy("url").agg(winner)
    found = keep(found.join(urls, "url").select("url", "pages", "best.rule", "best.action"), "found")
    # A URL that very many pages share is looked up in a broadcast of bounded size.
    judged = look_up(pages.select("page_id", "url"), found, "url", "pages", F.col("page_id"))
    return judged.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        "rule",
        F.coalesce("action", F.lit(default)).alias("verdict"),
    )
