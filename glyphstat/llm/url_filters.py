"""Host and path rules for URLs, with block decisions carried over redirects and canonical links.

A page's own rule, the longest that fits, decides. A page without one is blocked if a URL that is
equivalent to it is blocked by a rule, and allowed otherwise. URLs are equivalent if a chain of
redirects and canonical links, in either direction, connects them; an explicit allow rule of a page
always comes before a block of its equivalents. DataFrame functions only.

Defined cases: a URL that is null or has no ``://`` has an empty host and path, fits no rule and has
no equivalents; null pages have no links; links without a scheme are read relative to their page's
host; repeated rows get equal verdicts; other columns are ignored.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphstat.llm.components import components
from glyphstat.llm.storage import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?\s*([^"'\s>]+)"""
_TARGET = r"""(?is)\burl\s*=\s*["']?\s*([^"'\s>]+)"""


def after_scheme(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(rules: list[tuple[str, str, str]], host_: Column, path_: Column) -> tuple[Column, Column]:
    """The longest of ``rules`` (verdict, host, path) that fits, as text, and its verdict; else nulls."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host_ == name) | host_.endswith("." + name)) & path_.startswith(start)
        text = F.when(fits, F.lit(name + start)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def same_url(url: Column) -> Column:
    """The form in which URLs are compared: lower-case host, no scheme and no fragment."""
    rest = F.regexp_extract(after_scheme(url), r"^[^/?#]*([^#]*)", 1)
    return F.when(host(url) != "", F.concat(host(url), F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))))


def links(pages: DataFrame) -> DataFrame:
    """``(source, target)``: canonical links and immediate redirects in ``pages(url, html)``."""
    tags = F.concat(
        F.transform(F.regexp_extract_all("html", F.lit(_CANONICAL), F.lit(0)), lambda t: F.regexp_extract(t, _HREF, 1)),
        F.transform(F.regexp_extract_all("html", F.lit(_REFRESH), F.lit(0)), lambda t: F.regexp_extract(t, _TARGET, 1)),
    )
    url, to = F.col("url"), F.col("to")
    folder = F.regexp_extract(path(url), r"^.*/", 0)
    absolute = (
        F.when(F.instr(to, "://") > 0, to)
        .when(to.startswith("//"), F.concat(F.lit("http:"), to))
        .when(to.startswith("/"), F.concat(F.lit("http://"), host(url), to))
        .otherwise(F.concat(F.lit("http://"), host(url), F.when(folder == "", F.lit("/")).otherwise(folder), to))
    )
    return pages.select("url", F.explode(tags).alias("to")).filter("to <> ''").select(
        url.alias("source"), absolute.alias("target")
    )


def judge(pages: DataFrame, edges: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``edges(source, target)`` are equivalences."""
    # Columns of the pages never clash with those below: they travel in one struct.
    rows = pages.select(F.struct(*(F.col(c) for c in pages.columns)).alias("page"), F.col("url"))
    rows = rows.withColumns({"host": F.coalesce(host(F.col("url")), F.lit("")), "path": F.coalesce(path(F.col("url")), F.lit(""))})
    rule, own = rule_of(rules, F.col("host"), F.col("path"))
    rows = rows.withColumns({"rule": rule, "own": own, "key": same_url(F.col("url"))})

    # Written before it is filtered, so that the long expressions are not repeated in the filter.
    named = components(cut(edges.select(same_url(F.col("source")).alias("u"), same_url(F.col("target")).alias("v"))))
    # The rule of a member is found from its compared form, which starts with its host and path.
    at = F.concat(F.lit("http://"), F.col("node"))
    _, verdict = rule_of(rules, host(at), path(at))
    blocked = named.withColumn("rule", verdict).groupBy("component").agg(
        F.max(F.col("rule") == "block").alias("blocked")
    ).filter("blocked")
    aliases = named.join(blocked, "component").select(F.col("node").alias("key"), F.lit("block").alias("inherited"))
    return rows.join(aliases, "key", "left").select(
        "page", "host", "path", "rule", F.coalesce("own", "inherited", F.lit("allow")).alias("verdict")
    )
