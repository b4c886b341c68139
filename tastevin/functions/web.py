"""URLs, links and HTML as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules
from .text import clean_text, fold, part_pattern, word_pattern


def normalize_url(column: Column) -> Column:
    """Scheme added and lower-cased with the host, no trailing slash, no fragment; '' without a host."""
    raw = F.trim(F.coalesce(column, F.lit("")))
    full = F.when(raw.rlike("(?i)^https?://"), raw).otherwise(F.concat(F.lit("https://"), F.regexp_replace(raw, "^/+", "")))
    parts = [F.regexp_extract(full, "^([A-Za-z]+)://([^/?#]*)([^?#]*)(\\?[^#]*)?", k) for k in (1, 2, 3, 4)]
    out = F.concat(F.lower(parts[0]), F.lit("://"), F.lower(parts[1]), F.regexp_replace(parts[2], "/+$", ""), parts[3])
    return F.when((raw == "") | (parts[1] == ""), "").otherwise(out)


def domain(column: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(normalize_url(column), "^[a-z]+://([^/?#]*)", 1), "^www\\.", "")


def registrable_root(host: Column) -> Column:
    """The last two labels of a host, three after a short second-level one (co.uk)."""
    labels = F.split(F.regexp_replace(F.lower(host), "^www\\.", ""), "\\.")
    n = F.when(F.size(labels).cast("int") <= 2, F.size(labels)).when((F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin("co", "com", "org", "net", "ac", "gov"), F.lit(3)).otherwise(2)
    return F.array_join(F.slice(labels, F.size(labels) - n + 1, n), ".")


def same_site(left: Column, right: Column) -> Column:
    return registrable_root(domain(left)) == registrable_root(domain(right))


def is_safe_url(column: Column) -> Column:
    host = F.regexp_extract(F.lower(column), "^https?://([^/:?#]+)", 1)
    return (host != "") & ~host.rlike("^(localhost|127\\.|10\\.|192\\.168\\.|169\\.254\\.|0\\.|172\\.(1[6-9]|2\\d|3[01])\\.|\\[|.*\\.local$)")


def valid_website(column: Column) -> Column:
    """An address with a host that is a place's own: no social network, directory or ordering service."""
    host = domain(column)
    return (host != "") & ~host.rlike(part_pattern(rules.BLOCKED_HOSTS))


def joined_url(base: Column, href: Column) -> Column:
    """href as seen from a page at base, without a fragment: absolute, of the same scheme, from the root, relative, or a query alone; steps
    up and dots are resolved. '' for what isn't a page's address, and where base has no host."""
    to = F.regexp_replace(F.trim(F.coalesce(href, F.lit(""))), "#.*$", "")
    part = lambda k: F.regexp_extract(F.coalesce(base, F.lit("")), "^(https?:)(//[^/?#]+)([^?#]*)(\\?[^#]*)?", k)
    root, path = F.concat(part(1), part(2)), F.when(part(3) == "", "/").otherwise(part(3))
    folder = F.regexp_replace(path, "[^/]*$", "")
    full = F.when(to.startswith("/"), to).otherwise(F.concat(folder, to))
    place, query = F.regexp_extract(full, "^[^?]*", 0), F.regexp_extract(full, "\\?.*$", 0)
    steps = F.split(F.regexp_replace(place, "^/", ""), "/")
    walked = F.reduce(steps, F.array().cast("array<string>"), lambda done, s: F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))))
    ends = F.when(F.element_at(steps, -1).isin(".", "..") & (F.size(walked) > 0), "/").otherwise("")
    relative = F.concat(root, F.lit("/"), F.array_join(walked, "/"), ends, query)
    return (
        F.when(F.trim(F.coalesce(href, F.lit(""))) == "", "").when(to.rlike("(?i)^https?://[^/?#]"), to).when(to.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), "").when(part(2) == "", "")
        .when(to.startswith("//"), F.concat(part(1), to)).when(to == "", F.concat(root, part(3), part(4))).when(to.startswith("?"), F.concat(root, part(3), to)).otherwise(relative)
    )


def link_score(text: Column, host: Column, path: Column) -> Column:
    """Additive score of a link: list files, list hosts, strong and weak words, other menus."""
    hay = F.replace(fold(F.concat_ws(" ", text, F.lower(host), F.lower(path))), F.lit("_"), F.lit("-"))
    has = lambda words: hay.rlike(word_pattern(words, loose_hyphens=False))
    strong = has(rules.STRONG_LINK)
    add = lambda test, n: F.when(test, n).otherwise(0)
    return (
        add(F.lower(path).endswith(".pdf"), 20) + add(F.lower(host).startswith("wine.") | F.lower(host).contains(".wine."), 120) + add(strong, 80)
        + add(has(rules.WEAK_LINK), 10) + add(has(rules.OTHER_MENU) & ~strong, -60)
    )


def html_lines(html: Column) -> Column:
    """Array of the visible lines: block tags break lines, other tags are blanks, entities are resolved."""
    broken = F.regexp_replace(F.coalesce(html, F.lit("")), "(?i)<\\s*(?:br|p|div|li|tr|td|th|h[1-6])\\b[^>]*>", "\n")
    bare = F.regexp_replace(broken, "<[^>]+>", " ")
    return F.filter(F.transform(F.split(bare, "\\R"), clean_text), lambda x: x != "")


def html_links(html: Column) -> Column:
    """Array of struct(href, text) of the anchors."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)(<a\\b[^>]*href=\"[^\"]*\"[^>]*>.*?</a>)"), F.lit(1))
    return F.transform(found, lambda a: F.struct(F.regexp_extract(a, "(?is)href=\"([^\"]*)\"", 1).alias("href"), clean_text(F.regexp_replace(a, "<[^>]+>", " ")).alias("text")))


def html_title(html: Column) -> Column:
    return clean_text(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))


def json_ld(html: Column) -> Column:
    """Array of the JSON-LD scripts' bodies."""
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit("(?is)<script[^>]*application/ld\\+json[^>]*>(.*?)</script>"), F.lit(1))


def json_strings(value: Column) -> Column:
    """Distinct strings of a JSON list or scalar; of objects their value, url or website."""
    parsed = F.when(F.trim(value).startswith("["), F.from_json(value, "array<string>")).otherwise(F.array(F.trim(value)))
    one = F.transform(parsed, lambda x: F.trim(F.when(F.trim(x).startswith("{"), F.coalesce(F.get_json_object(x, "$.value"), F.get_json_object(x, "$.url"), F.get_json_object(x, "$.website"))).otherwise(F.regexp_replace(x, "^\"|\"$", ""))))
    return F.array_distinct(F.filter(F.coalesce(one, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != "")))


def is_event_page(path: Column) -> Column:
    """The address of a page about an event, a story or an offer."""
    return F.lower(path).rlike(word_pattern(rules.EVENT_PAGE))
