"""URL filters: host and path rules, and block decisions that reach aliases over redirects and canonical links."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.llm.components import connected_components
from leafmill.llm.scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: host, path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Rules that are compiled into the plan at most; more are joined.
COMPILED = 200


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, A-Z lower-cased; empty without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What stands between the host and the next ? or #; empty without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def matched(urls: DataFrame, rules: DataFrame | tuple) -> DataFrame:
    """urls (host, path, more) with rule (host and path of the longest that fits) and decided (its verdict), null where none does.

    A rule fits its host and all subdomains when the path begins with the rule's. rules: some
    (host, path, verdict), or a table of these of any size. A table is first joined by host
    endings to the lengths of paths that its rules have there, then by the beginnings of the
    path of these lengths: a host with very many rules brings a row for each length only.
    """
    if not isinstance(rules, DataFrame):
        if len(rules) <= COMPILED:
            out = F.lit(None).cast("struct<rule:string,decided:string>")
            for host, path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
                fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
                out = F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("decided"))).otherwise(out)
            return urls.withColumn("__m", out).select(*urls.columns, "__m.rule", "__m.decided")
        rules = urls.sparkSession.createDataFrame(list(rules), "host string, path string, verdict string")
    # of rules that repeat, the verdict that is first in the alphabet: allow before block
    rules = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("path")).alias("lengths")).withColumnRenamed("host", "ending")
    labels = F.split("host", r"\.")
    endings = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("host", "path").distinct()
    near = asked.withColumn("ending", F.explode(endings)).join(lengths, "ending")
    near = near.withColumn("n", F.explode("lengths")).where(F.col("n") <= F.length("path")).withColumn("begin", F.expr("left(path, n)"))
    rule = rules.select(F.col("host").alias("ending"), F.col("path").alias("begin"), "verdict")
    text = F.concat("ending", "begin")
    best = near.join(rule, ["ending", "begin"]).groupBy("host", "path").agg(F.max_by(F.struct(text.alias("rule"), F.col("verdict").alias("decided")), F.struct(F.length(text), text)).alias("__m"))
    return urls.join(best, ["host", "path"], "left").select(*urls.columns, "__m.rule", "__m.decided")


def address(url: Column) -> Column:
    """One spelling for urls that are the same by the rules of urls themselves: no fragment, user, default port or final dot of the host, and / for no path. Null without ://."""
    scheme = F.lower(F.regexp_extract(url, r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.regexp_replace(host_of(url), "^.*@", "")
    host = F.when(scheme == "http", F.regexp_replace(host, ":(80)?$", "")).when(scheme == "https", F.regexp_replace(host, ":(443)?$", "")).otherwise(host)
    host, path = F.regexp_replace(host, r"\.$", ""), path_of(url)
    query = F.regexp_extract(url, r"(?s)^[^#]*?://[^?#]*(\?[^#]*)", 1)
    return F.when(url.contains("://"), F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(path), query))


def declared_links(pages: DataFrame) -> DataFrame:
    """src and dst (absolute urls) of the canonical link and the refresh that a page declares in its html.

    Comments, scripts and styles declare nothing; a tag ends at its first >. Relative targets are resolved against the
    page's url; what is no http url then is left out. Only pages with either go to Python.
    """
    low = F.lower("html")
    html = F.regexp_replace("html", r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>", " ")
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    some = pages.where((low.contains("canonical") | low.contains("refresh")) & F.col("url").isNotNull()).select("url", F.explode(tags).alias("tag"))
    value = lambda name: F.coalesce(*[F.nullif(F.regexp_extract("tag", rf"(?is)\s{name}\s*=\s*{q}", 1), F.lit("")) for q in ('"([^"]*)"', "'([^']*)'", r"([^\s\"'>]+)")])
    canonical = F.when(F.lower(value("rel")).rlike(r"(^|\s)canonical(\s|$)"), value("href"))
    refresh = F.when(F.lower(value("http-equiv")) == "refresh", F.regexp_extract(value("content"), r"(?is)^\s*[\d.]*\s*[;,]?\s*url\s*=\s*['\"]?([^'\"]*)", 1))
    found = some.select("url", F.trim(F.replace(F.coalesce(canonical, refresh), F.lit("&amp;"), F.lit("&"))).alias("target")).where("target <> ''")

    def resolved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for url, target in zip(b["url"], b["target"], strict=True):
                try:
                    out.append((url, urljoin(url, target)))
                except ValueError:  # no url
                    continue
            yield pd.DataFrame(out, columns=["src", "dst"])

    return found.mapInPandas(resolved, "src string, dst string").where(F.lower("dst").rlike("^https?://"))


def filter_urls(pages: DataFrame, rules: DataFrame | tuple = RULES, redirects: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str | None = "html", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict and by_alias for each row of pages.

    A url's own rule, the longest that fits, decides. A url without one is blocked if any of
    its aliases is, directly or over others; else it has the default. Aliases are joined by
    redirects (table of src and dst urls), by the canonical link and the refresh that a page
    declares, and by spellings of one url (fragment, default port). A url that a rule allows
    stays allowed whatever its aliases are: allow takes precedence, and does not spread.
    Aliases need not be pages themselves: a redirect to a blocked url blocks.

    Components of aliases come from large-star and small-star over 128-bit digests; only urls
    that have an alias take part. A component may hold a third of all urls: its blocks are
    reduced to one row before they are joined back.

    Null urls, and those without ://, have empty host and path, and no aliases. Rows that
    repeat are judged alike. Null html declares nothing; html_col None: it is not read. An
    empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), *([F.col(html_col).alias("html")] if html_col else []))
    spelled = rows.where(F.col("url").contains("://")).select("url", address(F.col("url")).alias("to"))
    links = spelled.where(F.col("url") != F.col("to")).select(F.col("url").alias("src"), F.col("to").alias("dst"))
    pairs = [x.select("src", "dst") for x in ([declared_links(rows)] if html_col else []) + ([redirects] if redirects is not None else [])]
    for x in pairs:  # a link goes between spellings as they stand, each of which is an alias of its address
        ends = F.explode(F.array("src", "dst")).alias("url")
        other = x.where(F.col("src").contains("://") & F.col("dst").contains("://"))
        links = links.unionByName(other).unionByName(other.select(ends).select(F.col("url").alias("src"), address(F.col("url")).alias("dst")).where("src <> dst"))
    links = scratch.keep(links.where("src <> dst").distinct(), "links")
    digest = lambda c: F.unhex(F.md5(c))
    family = connected_components(links.select(digest("src").alias("src"), digest("dst").alias("dst")), scratch, kind="binary")

    nodes = links.select(F.explode(F.array("src", "dst")).alias("url")).distinct()
    judged = matched(nodes.select(digest("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    blocked = family.join(judged.where("decided = 'block'").select("node"), "node").select("component").distinct()
    reached = scratch.keep(family.join(blocked, "component").select("node", F.lit(True).alias("by_alias")), "reached")

    own = matched(rows.select("page_id", digest("url").alias("node"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")), rules)
    decided = own.where("decided is not null").withColumn("by_alias", F.lit(False))
    left = own.where("decided is null").join(reached, "node", "left").withColumn("by_alias", F.coalesce("by_alias", F.lit(False)))
    verdict = F.coalesce("decided", F.when(F.col("by_alias"), F.lit("block")).otherwise(F.lit(default)))
    return decided.unionByName(left).select("page_id", "host", "path", "rule", verdict.alias("verdict"), "by_alias")
