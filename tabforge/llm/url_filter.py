"""URL rules by expressions and hash prefixes, in DataFrame expressions only.

A rule names a host and the start of a path. A url is expanded into all expressions
that a rule could name: the suffixes of its host at the label counts that rules have,
joined with the starts of its path at the lengths that rules have. Expressions meet
rules by the first 32 bits of their SHA-256; the full digest then confirms them, and
the longest rule that is left decides.

Urls that no rule can tell apart (same last labels, same first characters of the path)
are expanded once, however many there are: they are counted together before anything
is joined, and the verdicts come back by a plain join, which adaptive execution
broadcasts or splits where one host holds much of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.registry import query
from tabforge.session import settle
from tabforge.sources.tables import load

#: Hexadecimal digits of the digest by which expressions and rules are joined.
SHORT = 8
DEFAULT = "allow"
#: (host, path, verdict) of the registered query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(_part(url, r"^([^/?#]*+)"), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return _part(url, r"^[^/?#]*+([^?#]*+)")


def _part(url: Column, pattern: str) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, pattern, 1)).otherwise("")


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def prepared_rules(rules: DataFrame) -> DataFrame:
    """short, digest, size, labels, chars, rule and verdict of each rule that some url may fit.

    Rules with a null, with a verdict other than allow or block, or that no url can fit
    (a host with ``/``, ``?`` or ``#``; a path with ``?`` or ``#``, or not starting with
    ``/``) are left out. Hosts count in lower case. Of equal rules one stays; block wins.
    """
    host = F.translate("host", _UPPER, _UPPER.lower())
    rows = rules.select(host.alias("host"), F.col("path").alias("path"), F.col("verdict").alias("verdict"))
    fits = "host NOT rlike '[/?#]' AND path NOT rlike '[?#]' AND (path = '' OR startswith(path, '/'))"
    rows = rows.where("verdict IN ('allow', 'block')").where(fits)
    rows = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    return rows.select(
        _digest(F.col("host"), F.col("path")).alias("digest"),
        (F.length("host") + F.length("path")).alias("size"),
        _labels(F.col("host")).alias("labels"),
        F.length("path").alias("chars"),
        F.concat("host", "path").alias("rule"),
        "verdict",
    ).withColumn("short", F.substring("digest", 1, SHORT))


def expressions(sites: DataFrame, labels: list[int], chars: list[int]) -> DataFrame:
    """(site, head, short, digest): every expression of a host's end and a path's start."""
    of_host = [F.when(_labels(F.col("site")) >= n, F.substring_index("site", ".", -n)) for n in labels]
    of_path = [F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in chars]
    rows = sites.withColumn("host", F.explode(F.array_compact(F.array(*of_host))))
    rows = rows.withColumn("path", F.explode(F.array_compact(F.array(*of_path))))
    digest = _digest(F.col("host"), F.col("path"))
    return rows.select("site", "head", digest.alias("digest")).withColumn("short", F.substring("digest", 1, SHORT))


def judge_urls(pages: DataFrame, rules: DataFrame, keys: list[str], url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The ``keys`` of every row with host, path, rule and verdict of its url.

    ``rules`` has host, path and verdict (allow or block). A rule fits its host and all
    subdomains if the url's path starts with the rule's; of those that fit the longest
    wins (host and path together, then the host alone). Where none fits, rule is null
    and the verdict is ``default``. A null url, or one without ``://``, has an empty host
    and path. Rows are judged one by one: repeated rows stay, other columns are not
    looked at. An empty table gives none, without rules all rows get ``default``.

    The label counts and path lengths that rules have are gathered; there are no more
    of them than labels and characters in the longest rule.
    """
    rules = settle(prepared_rules(rules))
    shape = rules.agg(F.collect_set("labels").alias("labels"), F.collect_set("chars").alias("chars")).first()
    address = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = pages.select(*[F.col(f"`{k}`") for k in keys], host_of(address).alias("host"), path_of(address).alias("path"))
    if not shape["labels"]:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    labels, chars = sorted(shape["labels"]), sorted(shape["chars"])
    rows = rows.withColumns(
        {"_site": F.substring_index("host", ".", -labels[-1]), "_head": F.substring("path", 1, chars[-1])}
    )
    sites = rows.select(F.col("_site").alias("site"), F.col("_head").alias("head")).distinct()
    each = expressions(sites, labels, chars).alias("e")
    met = each.join(rules.alias("r"), "short").where("e.digest = r.digest")
    order = F.struct("size", F.col("size") - F.col("chars"), "verdict", "rule")
    best = met.groupBy("site", "head").agg(F.max(order).alias("best"))
    best = settle(best.select("site", "head", F.col("best.rule").alias("_rule"), F.col("best.verdict").alias("_verdict")))
    found = rows.join(best, (F.col("_site") == F.col("site")) & (F.col("_head") == F.col("head")), "left")
    return found.select(
        *[F.col(f"`{k}`") for k in keys], "host", "path", F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit(default)).alias("verdict"),
    )


def keep_allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """The rows whose url is not blocked, with the input's columns."""
    rows = pages.select(F.struct("*").alias("_row"), F.col(f"`{url}`").alias("_url"))
    return judge_urls(rows, rules, ["_row"], "_url", default).where("verdict = 'allow'").select("_row.*")


_VALUES = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
SQL = f"""WITH rules(h, p, v) AS (VALUES {_VALUES}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS u FROM pages),
parts AS (SELECT page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
          regexp_extract(u, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT DISTINCT ON (host, path) host, path, h || p AS rule, v FROM (SELECT DISTINCT host, path FROM parts) d
        JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
        ORDER BY host, path, length(h || p) DESC, length(h) DESC)
SELECT page_id, host, path, rule, coalesce(v, '{DEFAULT}') AS verdict FROM parts LEFT JOIN fit USING (host, path)"""


@query("op13_url_filters", SQL)
def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(load(spark, sf_dir, "pages"), rules, ["page_id"])
