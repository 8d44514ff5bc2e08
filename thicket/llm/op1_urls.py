"""URL filters. Host-suffix and path-prefix expressions meet rules by a short hash prefix; the full digest confirms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.llm.common import spare, stored, table

#: (verdict, host, path) of the query's rules.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased. Path: then up to ? # or the end. Both empty without ://."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, host).otherwise(F.lit("")), F.when(at > 0, path).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """(r_verdict, r_host, r_path) without a Python data source."""
    rows = [F.struct(F.lit(v).alias("r_verdict"), F.lit(h).alias("r_host"), F.lit(p).alias("r_path")) for v, h, p in rules]
    if not rows:
        return spark.sql("SELECT '' AS r_verdict, '' AS r_host, '' AS r_path WHERE false")
    return spark.range(1).select(F.inline(F.array(*rows)))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", prefix_hex: int = 8) -> DataFrame:
    """pages with host, path, rule and verdict.

    rules: r_verdict, r_host, r_path. A rule fits its host and all subdomains if the path starts with the rule's; the
    longest rule (host and path together) wins, then the first by code point, then block before allow. A page that no rule
    fits has a null rule and the default verdict. Null urls and those without :// have an empty host and path. Columns of
    pages named host, path, rule or verdict are replaced. Repeated rows stay.

    A url is expanded only to suffixes of as many labels, and prefixes of as many characters, as some rule has: the sizes
    of both sets depend on the rules alone. Equal (suffix, prefix) keys are judged once, so a host with a third of all
    pages is reduced before the shuffle. The judged keys are written to the shared folder: the way back is a left join that
    is planned by their measured size, broadcast if small, and otherwise one of two plain exchanges, whose skewed parts
    adaptive execution splits, so that no task holds all pages of a host. No pages: no rows.
    """
    host, path = host_and_path(url)
    own = spare(pages.columns, "_host", "_path")
    named = pages.select("*", host.alias(own[0]), path.alias(own[1])).drop("host", "path", "rule", "verdict").withColumnsRenamed(dict(zip(own, ("host", "path"), strict=True)))
    rules = rules.select("r_verdict", "r_host", "r_path").where("r_host <> '' AND r_verdict IS NOT NULL AND r_path IS NOT NULL")
    shape = rules.agg(F.sort_array(F.collect_set(F.size(F.split("r_host", r"\.")))), F.sort_array(F.collect_set(F.length("r_path")))).first()
    labels, lengths = list(shape[0] or []), list(shape[1] or [])
    if not labels:
        return named.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    digest = lambda h, p: F.sha2(F.concat_ws("\n", h, p).cast("binary"), 256)
    known = rules.withColumns({"digest": digest(F.col("r_host"), F.col("r_path")), "r_rule": F.concat("r_host", "r_path")})
    known = known.groupBy("digest", "r_rule").agg(F.max("r_verdict").alias("r_verdict")).withColumn("short", F.substring("digest", 1, prefix_hex))

    tail, head, best = spare(named.columns, "_tail", "_head", "_best")
    named = named.withColumns({tail: F.substring_index("host", ".", -max(labels)), head: F.substring("path", 1, max(lengths))})
    # whether the host goes on beyond the tail decides nothing: a suffix starts at a label
    parts = F.split(tail, r"\.")
    keys = named.select(tail, head).where(F.col(tail) != "").distinct()
    tries = [
        F.when((F.size(parts) >= n) & (F.length(head) >= m), digest(F.substring_index(tail, ".", -n), F.substring(head, 1, m)))
        for n in labels for m in lengths
    ]
    asked = keys.select(tail, head, F.explode(F.array_compact(F.array(*tries))).alias("asked")).withColumn("short", F.substring("asked", 1, prefix_hex))
    # as one function of both digests the confirmation stays behind the join on the short prefix; digests are of one length
    found = asked.join(known, "short").where("instr(asked, digest) = 1")
    # the least of (-length, rule) wins
    judged = found.groupBy(tail, head).agg(F.min(F.struct((-F.length("r_rule")).alias("n"), F.col("r_rule"), F.col("r_verdict"))).alias(best))
    out = named.join(stored(judged), [tail, head], "left")
    return out.withColumns({"rule": F.col(f"{best}.r_rule"), "verdict": F.coalesce(f"{best}.r_verdict", F.lit(default))}).drop(tail, head, best)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; see filter_urls for odd rows."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark, RULES)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), named AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/'
  END AS rule FROM named
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
