"""URL rules with redirect equivalence (operator 3, DataFrame functions only).

A rule (host, path) fits its host and all subdomains when the url's path starts
with the rule's path; the longest rule wins, and between equal rules ``allow``. A url that no rule fits takes the decision of its alias
group: the connected component over redirects (``meta refresh``), declared
canonical links (``rel="canonical"``) and the url's own canonical form. An alias
group with any allowed url allows (explicit allow precedence), else one with a
blocked url blocks, else the default is allow.

Nulls and odd input: a null url, or one without ``://``, has empty host and path,
no rule, belongs to no alias group and is allowed. Repeated rows get equal rows.
A null html declares no link. Targets are resolved against the page's url (``//host/x``, ``/x``,
``x``, ``../x``, ``?x``); a bare fragment, another scheme (``mailto:``) and a relative target on a
url without ``://`` make no edge; ``<base>`` is not read. An empty table gives an empty result. Only the
columns named are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vocalframe.llm.components import connected_components
from vocalframe.llm.store import keep

#: Query parameters that do not change what a url names.
TRACKING = "utm_[^=&]*|ref|fbclid|gclid"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host up to ``/``, ``?``, ``#`` or the end, path up to ``?``, ``#`` or the end."""
    url = F.coalesce(url, F.lit(""))
    after = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = ascii_lower(F.regexp_extract(after, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. ``rules``
    (verdict, host, path) is a fixed list in the plan; the cost is per rule."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0]), reverse=True):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        best = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def canonical_form(url: Column) -> Column:
    """The url without scheme, fragment, tracking parameters, ``.html`` and a final slash;
    null when there is no ``://``."""
    host, path = split_url(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: (q != "") & ~q.rlike(f"^({TRACKING})(=|$)"))), "&")
    bare = F.regexp_replace(path, r"(\.html|/)$", "")
    return F.when(url.contains("://"), F.concat(host, bare, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def declared_links(html: Column) -> Column:
    """Targets of canonical links and meta redirects in a page, as written."""
    html = F.coalesce(html, F.lit(""))
    tags = F.regexp_extract_all(html, F.lit(r"(?is)(<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>)"), 1)
    canon = F.transform(tags, lambda t: F.regexp_extract(t, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1))
    metas = F.regexp_extract_all(html, F.lit(r"(?is)(<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>)"), 1)
    moved = F.transform(metas, lambda t: F.regexp_extract(t, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1))
    return F.filter(F.concat(canon, moved), lambda u: u != "")


def without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` segments taken out; ``..`` at the top stays at the top."""
    up = lambda acc: F.when(F.size(acc) > 1, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)
    segments = F.concat(F.split(path, "/"), F.when(path.rlike(r"(?s)/\.\.?$"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")))
    walked = F.aggregate(segments, F.array().cast("array<string>"), lambda acc, x: F.when(x == ".", acc)
                         .when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x))))
    return F.when(path.rlike(r"(?s)/\.\.?(/|$)"), F.array_join(walked, "/")).otherwise(path)


def resolved(base: Column, target: Column) -> Column:
    """The absolute url of a link target on the page ``base``; null where it names no other page."""
    scheme = F.regexp_extract(base, r"(?s)^(.*?)://", 1)
    authority = F.regexp_extract(base, r"(?s)^.*?://([^/?#]*)", 1)
    path = split_url(base)[1]
    own, rest = (F.regexp_extract(target, r"(?s)^([^?#]*)(.*)$", k) for k in (1, 2))
    folder = F.regexp_extract(path, r"(?s)^(.*/)", 1)
    joined = (F.when(own == "", path).when(own.startswith("/"), own)
              .otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), own)))
    return (F.when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
            .when(~base.contains("://") | target.startswith("#") | target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.lit(None))
            .when(target.startswith("//"), F.concat(scheme, F.lit(":"), target))
            .otherwise(F.concat(scheme, F.lit("://"), authority, without_dots(joined), rest)))


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]], page_id: str = "page_id",
                url: str = "url", html: str | None = "html") -> DataFrame:
    """(page_id, url, host, path, rule, verdict, via): ``via`` is ``rule``, ``alias`` or ``default``.

    The alias graph has a node per distinct url and per canonical form, and an edge
    from each url (of a page or of a declared target) to its form and from each page
    to its declared targets. Decisions per url and per component are partial
    minimums ('allow' sorts before 'block'), so no group is gathered in one task.
    """
    links = declared_links(F.col(html)) if html else F.array().cast("array<string>")
    judged = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), links.alias("links"))
    host, path = split_url(F.col("url"))
    judged = judged.select("page_id", "url", "links", host.alias("host"), path.alias("path"))
    judged = keep(judged.withColumn("r", rule_of(F.col("host"), F.col("path"), rules)))
    declared = judged.where("url is not null and size(links) > 0").select(
        F.col("url").alias("src"), F.explode("links").alias("dst")).distinct()
    declared = declared.select("src", resolved(F.col("src"), F.col("dst")).alias("dst")).where("dst is not null")
    urls = keep(judged.select("url").unionByName(declared.select(F.col("dst").alias("url")))
                .distinct().where(F.col("url").contains("://"))
                .select("url", F.concat(F.lit("//"), canonical_form(F.col("url"))).alias("form"),
                        rule_of(*split_url(F.col("url")), rules)["verdict"].alias("v")))
    edges = urls.select(F.col("url").alias("src"), F.col("form").alias("dst"))
    comp = connected_components(edges.unionByName(declared))
    by_root = (urls.where("v is not null").join(comp, F.col("url") == F.col("node"))
               .groupBy("component").agg(F.min("v").alias("alias_verdict")))
    decided = comp.join(by_root, "component").select("node", "alias_verdict")
    ruled = judged.where("r is not null").select(
        "page_id", "url", "host", "path", F.col("r.rule").alias("rule"),
        F.col("r.verdict").alias("verdict"), F.lit("rule").alias("via"))
    rest = judged.where("r is null").join(decided, F.col("url") == F.col("node"), "left").select(
        "page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"),
        F.coalesce("alias_verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("alias_verdict").isNotNull(), "alias").otherwise("default").alias("via"))
    return ruled.unionByName(rest)
