"""Allow and block rules on addresses, carried to their aliases.

Addresses that redirect to each other, name each other as canonical, or differ only in tracking
parameters or a fragment are the same resource. They are the edges of a graph; a block decision
holds for the whole component, but an explicit allow goes before it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import letters, picked, stored
from .components import components
from .quality_rules import let

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TRACKING = r"(?:utm_[a-z]+|fbclid|gclid)"


@dataclass(frozen=True)
class Rule:
    """Fits addresses on ``host`` or below it whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    def fits(self, host: Column, path: Column) -> Column:
        below = (host == self.host) | F.endswith(host, F.lit("." + self.host))
        return below & F.startswith(path, F.lit(self.path))


RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash sign or the end; A-Z lower."""
    host = F.regexp_extract(letters(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(letters(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_rules(url: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value`` of the longest rule that fits, or null."""
    host, path = host_of(url), path_of(url)
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host))):
        found = F.when(rule.fits(host, path), F.lit(value(rule))).otherwise(found)
    return found


def canonical_form(url: Column) -> Column:
    """The address without fragment and tracking parameters, host in lower case."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    bare = F.regexp_replace(bare, rf"([?&]){TRACKING}=[^&]*&", "$1")
    bare = F.regexp_replace(bare, rf"[?&]{TRACKING}=[^&]*$", "")

    def joined(x: Column) -> Column:
        head = F.regexp_extract(x, r"(?s)^(.*?://[^/?#]*)", 1)
        return F.concat(F.lower(head), F.substring(x, F.length(head) + 1, F.length(x)))

    return let(bare, joined)


def _absolute(link: Column, url: Column) -> Column:
    """A link of a page as an address; null if it has another scheme."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    origin = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(url, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*)?/)", 1)
    folder = F.when(folder == "", F.concat(origin, F.lit("/"))).otherwise(folder)

    def resolved(x: Column) -> Column:
        return (
            F.when(x.rlike("(?i)^https?://"), x)
            .when(x.rlike("^//"), F.concat(scheme, F.lit(":"), x))
            .when(x.rlike("^/"), F.concat(origin, x))
            .when(x.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|^#|^$"), F.lit(None))
            .otherwise(F.concat(folder, x))
        )

    return let(F.trim(link), resolved)


def _attribute(tag: Column, name: str) -> Column:
    value = rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return let(tag, lambda x: F.concat(*[F.regexp_extract(x, value, k) for k in (1, 2, 3)]))


def alias_edges(pages: DataFrame) -> DataFrame:
    """(a, b): an address of (url, html) rows, and one that stands for the same resource."""
    html, url = letters(F.col("html")), F.col("url")
    canonical = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    refresh = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    target = F.regexp_extract(_attribute(refresh, "content"), r"(?is)url\s*=\s*['\"]?([^'\"]*)", 1)
    links = pages.where(url.contains("://")).select(
        url.alias("a"),
        F.array(
            canonical_form(url),
            canonical_form(_absolute(F.nullif(_attribute(canonical, "href"), F.lit("")), url)),
            canonical_form(_absolute(F.nullif(target, F.lit("")), url)),
        ).alias("links"),
    )
    edges = links.select("a", F.explode("links").alias("b"))
    return edges.where("b is not null and a <> b")


def filtered(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    redirects: DataFrame | None = None,
    default: str = "allow",
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    An address that a rule fits has the verdict of the longest one. Another is blocked if its
    component holds a blocked address and no explicitly allowed one, and has ``default`` otherwise.
    ``redirects`` are further edges (a, b). A null address, or one without ``://``, has an empty host
    and path, no rule and no alias. A null page has no links. Repeated rows get repeated verdicts; other
    columns are not carried; no rows give no rows. Rules are a parameter and become one expression.
    """
    rows = picked(pages, page_id=id_col, url=url_col, html=html_col)
    edges = alias_edges(rows.select("url", "html"))
    if redirects is not None:
        given = redirects.select("a", "b")
        forms = given.select("b", canonical_form(F.col("b")).alias("c"))
        edges = edges.unionAll(given).unionAll(forms.toDF("a", "b"))
    members = stored(components(edges), "aliases")
    verdict = _by_rules(F.col("node"), rules, lambda r: r.verdict)
    blocked = (
        members.withColumn("verdict", verdict)
        .groupBy("component")
        .agg(
            F.coalesce(F.bool_or(F.col("verdict") == "block"), F.lit(False)).alias("block"),
            F.coalesce(F.bool_or(F.col("verdict") == "allow"), F.lit(False)).alias("allow"),
        )
        .where("block and not allow")
        .select("component")
    )
    aliases = members.join(blocked, "component").select(
        F.col("node").alias("url"), F.lit("block").alias("of_alias")
    )
    judged = rows.select(
        "page_id",
        "url",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        _by_rules(F.col("url"), rules, lambda r: r.name).alias("rule"),
        _by_rules(F.col("url"), rules, lambda r: r.verdict).alias("of_rule"),
    )
    found = judged.join(aliases, "url", "left")
    return found.select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("of_rule", "of_alias", F.lit(default)).alias("verdict"),
    )
