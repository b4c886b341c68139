"""File sources: CSV and XLSX price lists, HTML, PDF, sitemaps, JSON with fallback, packed chunks, paged payloads."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money, rules, text, web


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, row, line: the cells of every row joined by blanks, however many there are and whatever they hold (line breaks in
    quotes too); the byte order mark is dropped. A file is read as a stream where it lies."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(1 << 30)
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                for k, cells in enumerate(csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", "replace", newline=""))):
                    line = " ".join(" ".join(cells).split())
                    if line:
                        out.append((name, k, line))
                    if len(out) == 10_000:
                        yield pd.DataFrame(out, columns=["path", "row", "line"])
                        out = []
                yield pd.DataFrame(out, columns=["path", "row", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, row int, line string")


def xlsx_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, sheet, row, line of every row of every sheet: unzipped and parsed where the file lies."""
    ns = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    strings = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        strings = ["".join(t.text or "" for t in si.iter(f"{ns}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{ns}si")]
                    for sheet in sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
                        for k, row in enumerate(ElementTree.fromstring(z.read(sheet)).iter(f"{ns}row")):
                            cells = []
                            for c in row.iter(f"{ns}c"):
                                v = c.find(f"{ns}v")
                                inline = "".join(t.text or "" for t in c.iter(f"{ns}t"))
                                cells.append(strings[int(v.text)] if c.get("t") == "s" and v is not None else inline or (v.text if v is not None else ""))
                            line = " ".join(x for x in cells if x)
                            if line:
                                out.append((name, sheet, k, line))
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "line"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, sheet string, row int, line string")


def pdf_text(spark: SparkSession, path: str) -> DataFrame:
    """path, text, needs_ocr; needs the optional package pypdf on the executors."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pypdf import PdfReader

        for pdf in batches:
            texts = ["\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(c)).pages) for c in pdf["content"]]
            yield pd.DataFrame({"path": pdf["path"], "text": texts, "needs_ocr": [not t.strip() for t in texts]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, "path string, text string, needs_ocr boolean")


def html_page_lines(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return pages.select(key, F.posexplode(web.html_lines(F.col(html))).alias("pos", "line"))


def html_page_links(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    return pages.select(key, F.posexplode(web.html_links(F.col(html))).alias("pos", "link")).select(key, "pos", "link.href", "link.text")


def sitemap_urls(spark: SparkSession, path: str, site: str) -> DataFrame:
    """Distinct <loc> addresses of the site's own domain."""
    raw = spark.read.text(path, wholetext=True)
    found = raw.select(F.explode(F.regexp_extract_all("value", F.lit("(?s)<loc>\\s*(.*?)\\s*</loc>"), F.lit(1))).alias("url"))
    return found.where(web.domain(F.col("url")) == web.domain(F.lit(site))).distinct()


def json_or(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file's rows, none where it is missing; corrupt rows are dropped."""
    try:
        df = spark.read.schema(schema).json(path, mode="DROPMALFORMED", multiLine=True)
        df.take(1)
        return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


@F.pandas_udf(T.StringType())
def gunzip(packed: pd.Series) -> pd.Series:
    import gzip

    return packed.map(lambda b: None if b is None else gzip.decompress(b).decode())


@F.pandas_udf(T.BinaryType())
def gzipped(text: pd.Series) -> pd.Series:
    import gzip

    return text.map(lambda t: None if t is None else gzip.compress(t.encode(), 9, mtime=0))


def packed_chunks(chunks: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of gzip + base64 JSON arrays."""
    return chunks.select(F.explode(F.from_json(gunzip(F.unbase64(column)), f"array<{schema}>")).alias("row")).select("row.*")


def catalogue_variants(payloads: DataFrame, column: str = "value") -> DataFrame:
    """title, variant, price of recorded storefront payloads: products with variants."""
    kind = "struct<products:array<struct<title:string,variants:array<struct<title:string,price:string>>>>>"
    product = payloads.select(F.explode(F.from_json(column, kind)["products"]).alias("p"))
    return product.select(F.col("p.title").alias("title"), F.explode("p.variants").alias("v")).select("title", F.col("v.title").alias("variant"), F.col("v.price").try_cast("double").alias("price"))


def woo_products(payloads: DataFrame, column: str = "value") -> DataFrame:
    """name, price, currency, url of recorded pages of a shop's store API; prices are whole numbers of minor units."""
    kind = "array<struct<name:string,permalink:string,prices:struct<price:string,currency_code:string,currency_minor_unit:int>>>"
    p = payloads.select(F.explode(F.from_json(column, kind)).alias("p")).select("p.*")
    price = F.col("prices.price").try_cast("double") / F.pow(F.lit(10.0), F.coalesce(F.col("prices.currency_minor_unit"), F.lit(2)))
    return p.select(text.clean_text("name").alias("name"), price.alias("price"), F.coalesce("prices.currency_code", F.lit("")).alias("currency"), F.col("permalink").alias("url"))


def graph_products(payloads: DataFrame, column: str = "value") -> DataFrame:
    """name, variant, price, available, url of recorded pages of a storefront's graph API: nodes with nested variants; a
    discount price goes before the price."""
    variant = "struct<id:string,name:string,price:double,discountPrice:double,pageItemUrl:string,available:boolean>"
    kind = f"struct<data:struct<searchVariantsV2:struct<nodes:array<struct<productId:string,productName:string,pageItemUrl:string,product:struct<nodes:array<struct<variants:struct<nodes:array<{variant}>>>>>>>>>>"
    node = payloads.select(F.explode(F.from_json(column, kind)["data"]["searchVariantsV2"]["nodes"]).alias("n"))
    variants = F.flatten(F.transform(F.col("n.product.nodes"), lambda x: F.coalesce(x["variants"]["nodes"], F.array().cast(f"array<{variant}>"))))
    v = node.select(F.col("n.productName").alias("name"), F.col("n.pageItemUrl").alias("page"), F.explode(variants).alias("v"))
    return v.select("name", F.coalesce("v.name", F.lit("")).alias("variant"), F.coalesce("v.discountPrice", "v.price").alias("price"), F.coalesce("v.available", F.lit(False)).alias("available"), F.coalesce("v.pageItemUrl", "page").alias("url")).distinct()


def cards(pages: DataFrame, key: str, block: str, fields: dict[str, str], html: str = "html") -> DataFrame:
    """Cards of guide pages: a row for each part of the page that begins with block, with the first group of every field's
    pattern (tags dropped, '' where there is none) and its rank on the page."""
    parts = F.split(F.coalesce(F.col(html), F.lit("")), f"(?i)(?={block})")
    found = pages.select(key, F.posexplode(F.filter(parts, lambda p: p.rlike(f"(?is)^{block}"))).alias("pos", "card"))
    value = lambda pattern: text.clean_text(F.regexp_replace(F.regexp_extract("card", f"(?is){pattern}", 1), "<[^>]+>", " "))
    return found.select(key, (F.col("pos") + 1).alias("rank"), *(value(p).alias(name) for name, p in fields.items()))


NODE = "type string, name string, description string, url string, sku string, price string, currency string, availability string, city string, country string, street string, lat double, lng double, position int"


def json_ld_nodes(pages: DataFrame, key: str, html: str = "html") -> DataFrame:
    """Every object of the pages' JSON-LD scripts, however deep, with the fields that places and products have. Scripts that
    aren't JSON give none. Nesting has no bound, so objects are walked in Python, in batches."""

    def text_of(value) -> str:
        return "" if value is None or isinstance(value, (dict, list)) else str(value)

    def first(value):
        return (value[0] if value else None) if isinstance(value, list) else value

    def number(value):
        try:
            return float(value)
        except (TypeError, ValueError):
            return None

    def row(obj: dict) -> tuple:
        kind = obj.get("@type") or obj.get("type") or ""
        offer, address, geo = (x if isinstance(x, dict) else {} for x in (first(obj.get("offers")), obj.get("address"), obj.get("geo")))
        where = first(obj.get("url") or obj.get("sameAs") or obj.get("website"))
        rank = number(obj.get("position") or obj.get("rank"))
        return (
            " ".join(map(str, kind)) if isinstance(kind, list) else str(kind), text_of(obj.get("name") or obj.get("title")), text_of(obj.get("description")), text_of(offer.get("url")) or text_of(where), text_of(obj.get("sku") or obj.get("productID")),
            text_of(offer.get("price") or offer.get("lowPrice")), text_of(offer.get("priceCurrency")), text_of(offer.get("availability")).rsplit("/", 1)[-1],
            text_of(address.get("addressLocality") or address.get("city") or obj.get("city")), text_of(first(address.get("addressCountry")) or address.get("country") or obj.get("country")),
            text_of(address.get("streetAddress")) or text_of(obj.get("address")), number(geo.get("latitude")), number(geo.get("longitude")), None if rank is None else int(rank))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for k, body in zip(pdf[key], pdf["body"], strict=True):
                try:
                    open_ = [json.loads(body)]
                except ValueError:
                    continue
                while open_:
                    value = open_.pop()
                    if isinstance(value, dict):
                        out.append((k, *row(value)))
                        open_ += value.values()
                    elif isinstance(value, list):
                        open_ += value
            yield pd.DataFrame(out, columns=[key, *(c.split()[0] for c in NODE.split(", "))])

    bodies = pages.select(key, F.explode(web.json_ld(F.col(html))).alias("body"))
    return bodies.mapInPandas(walk, f"`{key}` {dict(pages.dtypes)[key]}, {NODE}")


def json_ld_places(nodes: DataFrame) -> DataFrame:
    """Nodes that are places: named, and of a type that says so."""
    return nodes.where((F.col("name") != "") & F.col("type").rlike("(?i)restaurant|food|venue|place|card|item"))


def json_ld_products(nodes: DataFrame) -> DataFrame:
    """Nodes that are products with a term of evidence, their price as a number."""
    evidence = text.fold(F.concat_ws(" ", "name", "description")).rlike(text.part_pattern(rules.EVIDENCE))
    typed = F.array_contains(F.split(F.lower("type"), " "), "product")
    return nodes.where(typed & evidence).withColumn("price_value", money.shop_number(F.regexp_replace("price", "[^0-9.,]", "")))


def place_scan(spark: SparkSession, path: str, wanted: dict[str, str], country: str | None = None, bbox: tuple[float, float, float, float] | None = None) -> DataFrame:
    """A directory's Parquet files (a path or glob) as the wanted columns (name: type); what a release lacks is null. Country
    code and box (west, south, east, north) are tested on the file's own columns, so that they reach its scan."""
    df = spark.read.parquet(path)
    if country and "country_code" in df.columns:
        df = df.where(F.col("country_code") == country.upper())
    if bbox and {"latitude", "longitude"} <= set(df.columns):
        west, south, east, north = bbox
        df = df.where(F.col("longitude").between(west, east) & F.col("latitude").between(south, north))
    return df.select(*((F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()))
