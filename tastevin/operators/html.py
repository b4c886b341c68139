"""HTML as tables: a tokenizer (one state machine over tags) behind a DataFrame operator and a SQL table function.

The tokenizer knows comments, quoted, unquoted and missing attribute values, elements of raw text, broken tags and entities; it never
fails. Pages are tokenized where they are, in Arrow batches; nothing is shuffled.

What is visible: all text but that of scripts, styles and noscripts. Block elements begin and end a line, any other tag is a
blank. Facts of a page are its title, first- and second-level headings, meta fields, canonical address, links with their
text, and JSON-LD scripts. A null page has none of either.

Entities are resolved as browsers do, which take old names (&amp, &copy) without their semicolon too; with `closed` only those that end in
one are, as in `text.unescaped`.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import partial
from html.entities import html5

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Elements that begin and end a line; br only begins one.
BLOCKS = frozenset("p div li tr h1 h2 h3 h4 h5 h6".split())
HIDDEN = frozenset("script style noscript".split())
_RAW = HIDDEN | {"title", "textarea"}
_NAME = re.compile(r"[A-Za-z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""[\s/]*([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_ENTITY = re.compile(r"&(?:#(?:\d+|[xX][0-9a-fA-F]+)|([A-Za-z]\w*));", re.A)
FACTS = "place int, kind string, name string, value string"
LINES = "line_no int, line string"


def _closed(body: str) -> str:
    """Entities that end in a semicolon resolved, each once; what is none stays."""
    return _ENTITY.sub(lambda m: html5.get(m[1] + ";", m[0]) if m[1] else html.unescape(m[0]), body)


def tokens(page: str, closed: bool = False) -> Iterator[tuple[str, str, dict[str, str]]]:
    """("text", body, {}), ("open", tag, attributes), ("close", tag, {}) in order; a raw element's body is one text."""
    at, n, resolved = 0, len(page), _closed if closed else html.unescape
    while at < n:
        start = page.find("<", at)
        if start < 0:
            start = n
        if start > at:
            yield "text", resolved(page[at:start]), {}
        if start == n:
            return
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = n if end < 0 else end + 3
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            end = page.find(">", start)
            at = n if end < 0 else end + 1
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if name is None:  # a lone < is text
            yield "text", "<", {}
            at = start + 1
            continue
        tag, at = name.group().lower(), name.end()
        given: dict[str, str] = {}
        while at < n and (found := _ATTRIBUTE.match(page, at)):
            value = next((v for v in found.groups()[1:] if v is not None), "")
            given.setdefault(found.group(1).lower(), resolved(value))
            at = found.end()
        end = page.find(">", at)
        at = n if end < 0 else end + 1
        yield ("close" if closing else "open"), tag, given
        if not closing and tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])|\Z", re.I).search(page, at).start()
            body = page[at:end]
            yield "text", body if tag in HIDDEN else resolved(body), {}
            at = end


def visible_lines(page: str | None, closed: bool = False) -> list[str]:
    """The lines that a reader sees, white space collapsed, none empty."""
    parts, hidden = [], False
    for kind, what, _ in tokens(page or "", closed):
        if kind == "text":
            parts.append("" if hidden else what.replace("\n", " "))
        elif what in HIDDEN:
            hidden = kind == "open"
        parts.append("\n" if kind != "text" and (what in BLOCKS or (what == "br" and kind == "open")) else " ")
    return [line for line in (" ".join(x.split()) for x in "".join(parts).split("\n")) if line]


def facts(page: str | None, closed: bool = False) -> list[tuple[str, str, str]]:
    """(kind, name, value) in order of the elements' ends: title, heading (h1, h2), meta (name or property), canonical, link (href, text), json_ld."""
    out, open_, texts, hidden = [], {}, {}, ""
    for kind, what, given in tokens(page or "", closed):
        if kind == "text":
            clean = " ".join(what.split())
            for element in texts if not hidden else ([hidden] if hidden in texts else []):
                texts[element].append(what if element == "script" else clean)
        elif kind == "open":
            if what == "meta" and (key := given.get("property") or given.get("name")) and given.get("content"):
                out.append(("meta", key.lower(), given["content"]))
            elif what == "link" and "canonical" in given.get("rel", "").lower().split():
                out.append(("canonical", "", given.get("href", "")))
            elif what in ("title", "h1", "h2") or (what == "a" and given.get("href")) or (what == "script" and "ld+json" in given.get("type", "").lower()):
                open_[what], texts[what] = given, []
            hidden = what if what in HIDDEN else hidden
        else:
            hidden = "" if what == hidden else hidden
            if what in texts:
                given, body = open_.pop(what), texts.pop(what)
                joined = "".join(body) if what == "script" else " ".join(x for x in body if x)
                if what == "a":
                    out.append(("link", given["href"], joined))
                elif what == "script":
                    out.append(("json_ld", "", joined))
                elif joined:
                    out.append(("title" if what == "title" else "heading", "" if what == "title" else what, joined))
    return out


def _each(find, names: list[str], kinds: list[pa.DataType], key: str):
    """Rows of find(page) with the page's key and their place in it."""

    def run(batches):
        for batch in batches:
            found = [find(x) for x in batch.column("html").to_pylist()]
            owner = pa.array([k for k, rows in enumerate(found) for _ in rows], pa.int64())
            columns = {key: batch.column(key).take(owner), names[0]: pa.array([i for rows in found for i in range(len(rows))], pa.int32())}
            flat = [r for rows in found for r in rows]
            columns |= {c: pa.array([r[i] for r in flat] if len(names) > 2 else flat, t) for i, (c, t) in enumerate(zip(names[1:], kinds, strict=True))}
            yield pa.record_batch(columns)

    return run


def _mapped(pages: DataFrame, key: str, body: str, find, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]
    rows = pages.select(F.col(key), F.col(body).cast("string").alias("html"))
    kind = rows.schema[0].dataType.simpleString()
    return rows.mapInArrow(_each(find, names, [pa.string()] * (len(names) - 1), key), f"`{key}` {kind}, {schema}")


def page_lines(pages: DataFrame, key: str, body: str = "html", closed: bool = False) -> DataFrame:
    """key, line_no, line of each page's visible lines."""
    return _mapped(pages, key, body, partial(visible_lines, closed=closed), LINES)


def page_texts(pages: DataFrame, key: str, body: str = "html", closed: bool = False) -> DataFrame:
    """key, lines of every page: one row for each, whether or not others have its key."""

    def each(batches):
        for batch in batches:
            found = [visible_lines(x, closed) for x in batch.column("html").to_pylist()]
            yield pa.record_batch({key: batch.column(key), "lines": pa.array(found, pa.list_(pa.string()))})

    rows = pages.select(F.col(key), F.col(body).cast("string").alias("html"))
    return rows.mapInArrow(each, f"`{key}` {rows.schema[0].dataType.simpleString()}, lines array<string>")


def page_facts(pages: DataFrame, key: str, body: str = "html", closed: bool = False) -> DataFrame:
    """key, place, kind, name, value of each page's facts."""
    return _mapped(pages, key, body, partial(facts, closed=closed), FACTS)


PROFILE = "title string, meta string, links array<struct<href:string,text:string>>, body string"
_LINK = pa.struct([("href", pa.string()), ("text", pa.string())])


def page_profiles(pages: DataFrame, key: str, url: str, body: str = "html") -> DataFrame:
    """key, url and a page's title and headings, meta values, links and visible text, one row for each page."""

    def each(batches):
        for batch in batches:
            rows = []
            for page in batch.column("html").to_pylist():
                found = facts(page)
                pick = lambda *kinds: " ".join(v for k, _, v in found if k in kinds)  # noqa: B023, E731
                rows.append((pick("title", "heading"), pick("meta"), [{"href": n, "text": v} for k, n, v in found if k == "link"], " ".join(visible_lines(page))))
            title, meta, links, text_ = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.record_batch({key: batch.column(key), "url": batch.column("url"), "title": pa.array(title, pa.string()), "meta": pa.array(meta, pa.string()), "links": pa.array(links, pa.list_(_LINK)), "body": pa.array(text_, pa.string())})

    rows = pages.select(F.col(key), F.col(url).cast("string").alias("url"), F.col(body).cast("string").alias("html"))
    return rows.mapInArrow(each, f"`{key}` {rows.schema[0].dataType.simpleString()}, url string, {PROFILE}")


class _Facts:
    def eval(self, page: str, closed: bool = False):
        for k, (kind, name, value) in enumerate(facts(page, closed)):
            yield k, kind, name, value


class _Lines:
    def eval(self, page: str, closed: bool = False):
        yield from enumerate(visible_lines(page, closed))


#: Table functions for lateral joins.
html_facts = F.udtf(_Facts, returnType=FACTS, useArrow=True)
html_lines = F.udtf(_Lines, returnType=LINES, useArrow=True)


def register(spark: SparkSession) -> None:
    """html_facts(page) and html_lines(page) in SQL: select ... from pages, lateral html_facts(html)."""
    spark.udtf.register("html_facts", html_facts)
    spark.udtf.register("html_lines", html_lines)
