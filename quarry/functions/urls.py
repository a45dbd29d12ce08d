"""URL and content functions of crawling, as column expressions."""

from __future__ import annotations

import re
from functools import reduce as fold

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and networks that a crawler must not reach.
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "instance-data"]
BLOCKED_NETWORKS = ["^127[.]", "^10[.]", "^192[.]168[.]", "^172[.](1[6-9]|2[0-9]|3[01])[.]", "^169[.]254[.]", "^0[.]", "^(22[4-9]|2[3-5][0-9])[.]"]
#: Loopback, unspecified, unique local, link-local and mapped private addresses.
BLOCKED_SIX = "^(::1?|f[cd][0-9a-f]{2}:.*|fe[89ab][0-9a-f]:.*|::ffff:(127|10|0|192[.]168|169[.]254|172[.](1[6-9]|2[0-9]|3[01]))[.].*)$"
#: A link's address with its quotation marks.
LINK = """(?i)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|'[^']*'|[^\\s"'>]+)"""
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 2))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), "^.*@", ""), ":[0-9]*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def _bare_path(url: Column) -> Column:
    p = F.regexp_replace(path(url), "/+$", "")
    return F.when(p == "", "/").otherwise(p)


def crawl_form(url: Column) -> Column:
    """Host in lower case, no fragment, no slash at the end; the query stays."""
    q = query(url)
    return F.concat(F.regexp_extract(url, PARTS, 1), F.lit("://"), authority(url), _bare_path(url), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def dedup_form(url: Column) -> Column:
    """As crawl_form, scheme in lower case and without the query."""
    return F.concat(scheme(url), F.lit("://"), authority(url), _bare_path(url))


def url_hash(url: Column) -> Column:
    return F.sha2(dedup_form(url), 256)


def slug(url: Column) -> Column:
    """A file name for a url: the path's letters and digits, and eight digits of its hash."""
    p = F.btrim(F.regexp_replace(path(url), "[^A-Za-z0-9]+", "_"), F.lit("_"))
    return F.concat_ws("_", F.nullif(F.substring(p, 1, 50), F.lit("")), F.substring(F.sha2(url, 256), 1, 8))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda x: x != "")


def depth(url: Column, base: Column) -> Column:
    """Path segments below base; all of them where base is no prefix, 0 on another host."""
    mine, root = segments(url), segments(base)
    below = F.slice(mine, 1, F.greatest(F.size(root), F.lit(1))) == root
    return F.when(host(url) != host(base), 0).when((F.size(root) == 0) | below, F.size(mine) - F.size(root)).otherwise(F.size(mine))


def domain(url: Column) -> Column:
    return F.substring_index(host(url), ".", -2)


def in_scope(url: Column, base: Column, scope: str) -> Column:
    """subpages: below base; hostname: same host; domain: same last two labels."""
    if scope == "domain":
        return domain(url) == domain(base)
    if scope == "hostname":
        return host(url) == host(base)
    return (host(url) == host(base)) & F.startswith(path(url), F.regexp_replace(path(base), "/+$", ""))


def glob_regex(pattern: str) -> str:
    """A glob, whose star crosses slashes, as a regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def crawlable(url: Column, base: Column, scope: str, include: list[str] = (), exclude: list[str] = ()) -> Column:
    """In scope, matching one of include (if any is given) and none of exclude."""
    some = lambda globs: fold(lambda a, b: a | b, [url.rlike(glob_regex(g)) for g in globs], F.lit(False))
    return in_scope(url, base, scope) & (some(include) if include else F.lit(True)) & ~some(exclude)


def reachable(url: Column) -> Column:
    """Neither a blocked name nor a private, loopback, link-local or reserved address of either kind."""
    h = host(url)
    bad = h.isin(BLOCKED_HOSTS) | F.contains(url, F.lit("169.254.169.254"))
    address = h.rlike("^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$")
    inner = fold(lambda a, b: a | b, [h.rlike(n) for n in BLOCKED_NETWORKS])
    six = F.lower(F.regexp_extract(authority(url), r"\[([0-9A-Fa-f:.]+)\]", 1))
    private = six.rlike(BLOCKED_SIX)
    return scheme(url).isin("http", "https") & (h != "") & ~bad & ~(address & inner) & ~private


def links(html: Column) -> Column:
    """Addresses of a page's links in order, quoted in either way or bare, without those inside the page and other schemes."""
    found = F.regexp_extract_all(html, F.lit(LINK), F.lit(1))
    plain = F.transform(found, lambda x: F.replace(F.regexp_replace(x, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))
    return F.array_distinct(F.filter(plain, lambda x: ~F.lower(x).rlike("^(#|javascript:|mailto:|tel:|data:)") & (x != "")))


def absolute(link: Column, base: Column) -> Column:
    """A link of a page with that base: absolute, with another host, from the root, with another query, or beside the page; steps up (..) are taken."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    here = F.when(path(base) == "", F.lit("/")).otherwise(path(base))
    tail = F.regexp_extract(link, "([?#][\\s\\S]*)$", 1)
    name = F.regexp_replace(link, "[?#][\\s\\S]*$", "")
    whole = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.regexp_replace(here, "[^/]*$", ""), name))
    parts = F.split(whole, "/")
    last = F.element_at(parts, -1)
    step = lambda s, x: F.when(x == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(1)))).when(x == ".", s).otherwise(F.concat(s, F.array(x)))
    walked = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    walked = F.concat(F.array_join(walked, "/"), F.when(last.isin("..", "."), F.lit("/")).otherwise(""))
    walked = F.when(F.contains(F.concat(whole, F.lit("/")), F.lit("/./")) | F.contains(F.concat(whole, F.lit("/")), F.lit("/../")), walked).otherwise(whole)
    beside = F.when(name == "", F.concat(root, here, tail)).otherwise(F.concat(root, walked, tail))
    return F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link).when(F.startswith(link, F.lit("//")), F.concat(scheme(base), F.lit(":"), link)).otherwise(beside)


def content_form(text: Column) -> Column:
    """Text for comparison: what stands between lines of three dashes goes, white space is one blank."""
    lines = F.split(text, "\n")
    kept = F.aggregate(
        lines,
        F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("lines")),
        lambda s, x: F.struct(
            F.when(F.trim(x) == "---", ~s["inside"]).otherwise(s["inside"]).alias("inside"),
            F.when((F.trim(x) == "---") | s["inside"], s["lines"]).otherwise(F.concat(s["lines"], F.array(x))).alias("lines"),
        ),
        lambda s: F.array_join(s["lines"], "\n"),
    )
    plain = F.when(F.contains(text, F.lit("---")), kept).otherwise(text)
    return F.trim(F.regexp_replace(plain, "[ \\t\\n\\r\\f\\x0B]+", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(content_form(text), 256)
