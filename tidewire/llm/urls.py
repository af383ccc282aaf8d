"""URL filters: rules on hosts and paths, spread over redirect-equivalent URLs.

Edges join a page's URL with its redirect targets (``meta refresh``), with its
canonical link (``link rel=canonical``, ``og:url``) and with its own canonical
form (no fragment, no tracking parameters).  Connected components over these
edges are classes of aliases.  A URL that a rule fits takes that rule's verdict.
Any other takes its class's: allow if an allow rule fits any member, else block
if a block rule fits any member, else allow.

A rule ``host/path`` fits its host and all subdomains where the URL's path
starts with the rule's path; the longest rule wins, then the longer host.
Rules are matched by keys (host suffix, and path cut to the lengths of that
suffix's rules), so their number does not multiply the rows; the rule table is
broadcast only when it has at most ``BROADCAST_RULES`` rows.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no rule, and no aliases; empty tables give empty results; repeated rows are
judged alike; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.components import components
from .session import checkpoint

BROADCAST_RULES = 10_000
#: The rules of the contract, as (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Text in which no tag counts: comments, and elements whose content is no markup, up to the end of the page if not closed.
NO_MARKUP = r"(?is)<!--.*?(?:-->|\z)|<(script|style|textarea|title|template|xmp)\b.*?(?:</\1\s*+>|\z)"
#: A tag to its end, or that of the page, so that a page is read once; a quote opens a value only after an equals sign.
TAG = r"""(?is)<(?:link|meta)\b(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+(?:>|\z)"""
#: Query parameters that never change a page.
TRACKING = r"(?:utm_[A-Za-z]+|ref|fbclid|gclid)=[^&#]*"


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Without the fragment and without tracking parameters; scheme and host in lower case."""
    root = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    bare = F.regexp_replace(F.concat(F.translate(root, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.substring(url, F.length(root) + 1, F.length(url))), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, rf"(?<=[?&]){TRACKING}", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\?&+", "?"), r"&{2,}", "&"), r"[?&]+$", "")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([(h, p, h + p, v) for h, p, v in rules], "rule_host string, rule_path string, rule string, rule_verdict string")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``urls`` (url, host, path), unique by url, with the longest fitting rule and its verdict, or nulls."""
    n = rules.count()
    sized = rules.withColumn("size", F.length("rule_path"))
    lengths = sized.groupBy("rule_host").agg(F.collect_set("size").alias("sizes"))
    sized = sized.withColumnRenamed("rule_path", "cut")
    if n <= BROADCAST_RULES:
        lengths, sized = F.broadcast(lengths), F.broadcast(sized)
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.where("host <> ''").select("url", "path", F.explode(F.array_distinct(suffixes)).alias("rule_host")).join(lengths, "rule_host")
    cut = keyed.select("url", "rule_host", F.explode("sizes").alias("size"), "path").where(F.length("path") >= F.col("size")).withColumn("cut", F.expr("left(path, size)"))
    best = cut.join(sized, ["rule_host", "size", "cut"]).groupBy("url").agg(F.max(F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), "rule", "rule_verdict")).alias("best"))
    return urls.join(best, "url", "left").select(*urls.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict"))


def _flat(path: Column) -> Column:
    """A path that begins with a slash, without its segments ``.`` and ``..``."""
    parts = F.split(path, "/")
    step = lambda held, x: F.when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).when(x == ".", held).otherwise(F.concat(held, F.array(x)))
    kept = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))


def _absolute(target: Column, base: Column) -> Column:
    """``target`` as seen from the page ``base``; null for schemes without ``//``."""
    for entity, to in (("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")):
        target = F.replace(target, F.lit(entity), F.lit(to))
    target = F.trim(target)
    root = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"(?s)^(.*?:)//", 1)
    own, rest = F.regexp_extract(target, r"(?s)^([^?#]*)", 1), F.regexp_extract(target, r"(?s)^[^?#]*(.*)$", 1)
    folder = F.concat(F.lit("/"), F.regexp_extract(path(base), r"(?s)^/(.*/)", 1))
    below = F.concat(root, _flat(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own))), rest)
    return (
        F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), target)
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), F.lit(None))
        .when(target.startswith("//"), F.concat(scheme, target))
        .when(target.startswith("?"), F.concat(root, path(base), target))
        .when(target.startswith("#"), F.concat(F.regexp_replace(base, r"(?s)#.*$", ""), target))
        .otherwise(below)
    )


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b) pairs of URLs that redirect to, or are canonical links of, each other; tags in comments, scripts and other text without markup do not count."""
    html = F.regexp_replace(F.coalesce("html", F.lit("")), NO_MARKUP, " ")
    tags = F.filter(F.regexp_extract_all(html, F.lit(TAG), F.lit(0)), lambda t: t.endswith(">"))
    value = r"""(?is)\b%s\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    of = lambda tag, name: F.concat(*[F.regexp_extract(tag, value % name, i) for i in (1, 2, 3)])
    goal = r"""(?is)url\s*=\s*(?:"([^"]*)|'([^']*)|([^\s"']\S*))"""
    refresh = lambda t: F.concat(*[F.regexp_extract(of(t, "content"), goal, i) for i in (1, 2, 3)])
    target = lambda t: (
        F.when(F.array_contains(F.split(F.lower(of(t, "rel")), r"\s+"), "canonical"), of(t, "href")).when(F.lower(of(t, "http-equiv")) == "refresh", refresh(t)).when(F.lower(of(t, "property")) == "og:url", of(t, "content"))
    )
    usable = pages.where(F.col("url").contains("://"))
    linked = usable.select("url", F.explode(F.transform(tags, target)).alias("target")).where("target <> ''").select(F.col("url").alias("a"), canonical(_absolute(F.col("target"), F.col("url"))).alias("b"))
    return linked.unionByName(usable.select(F.col("url").alias("a"), canonical(F.col("url")).alias("b"))).where("b IS NOT NULL AND a <> b").distinct()


def judge(pages: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, and alias_root (the smallest URL of its class)."""
    pages = pages.select("page_id", "url", "html")
    rules = rules if rules is not None else rule_table(pages.sparkSession)
    edges = checkpoint(alias_edges(pages))
    urls = pages.select("url").where("url IS NOT NULL").unionByName(edges.select(F.col("b").alias("url"))).distinct()
    judged = checkpoint(match(urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules))
    classes = components(edges)
    member = judged.join(classes.withColumnRenamed("node", "url"), "url", "left").withColumn("root", F.coalesce("root", "url"))
    of_class = member.groupBy("root").agg(F.coalesce(F.bool_or(F.col("rule_verdict") == "allow"), F.lit(False)).alias("allowed"), F.coalesce(F.bool_or(F.col("rule_verdict") == "block"), F.lit(False)).alias("blocked"))
    verdict = F.when(F.col("rule_verdict").isNotNull(), F.col("rule_verdict")).when(F.col("allowed") | ~F.col("blocked"), "allow").otherwise("block")
    known = member.join(of_class, "root").select("url", "rule", verdict.alias("verdict"), F.col("root").alias("alias_root"))
    return pages.select("page_id", "url").join(known, "url", "left").select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "alias_root")
