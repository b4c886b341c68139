"""Lines from documents: candidates, scores, source confidence, sections, fragments."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import money, rules, text
from ..sources import shared


def document_lines(docs: DataFrame, key: str, body: str = "text") -> DataFrame:
    """key, pos, line: cleaned, without the empty ones."""
    lines = F.filter(F.transform(F.split(F.coalesce(body, F.lit("")), "[\\r\\n]+"), text.clean_text), lambda x: x != "")
    return docs.select(key, F.posexplode(lines).alias("pos", "line"))


def candidate_lines(lines: DataFrame, key: str, priced: Column, identity: Column) -> DataFrame:
    """Lines, and where a price and its product stand on different lines, the line with its one or two neighbours.

    Before it for a price without identity, after it for an identity without price; each text once, at its first place."""
    w = W.partitionBy(key).orderBy("pos")
    near = lines.withColumns({"p1": F.lag("line", 1).over(w), "p2": F.lag("line", 2).over(w), "n1": F.lead("line", 1).over(w), "n2": F.lead("line", 2).over(w)}).withColumns({"priced": priced, "identity": identity})
    join = lambda *cs: F.concat_ws(" ", *map(F.col, cs))
    back = F.when(F.col("priced") & ~F.col("identity"), F.array(join("p1", "line"), join("p2", "p1", "line")))
    ahead = F.when(F.col("identity") & ~F.col("priced"), F.array(join("line", "n1"), join("line", "n1", "n2")))
    more = F.concat(F.array("line"), F.coalesce(back, F.array().cast("array<string>")), F.coalesce(ahead, F.array().cast("array<string>")))
    out = near.select(key, "pos", F.posexplode(more).alias("turn", "candidate"))
    place = F.struct(F.when(F.col("turn") == 0, 0).otherwise(1).alias("kind"), F.col("pos"), F.col("turn"))
    return out.groupBy(key, "candidate").agg(F.min(place).alias("at")).select(key, "candidate", F.col("at.kind").alias("kind"), F.col("at.pos").alias("pos"), F.col("at.turn").alias("turn"))


def word_test(folded: Column, words: str | list[str]) -> Column:
    """A whole word of a list, or of a pattern."""
    return folded.rlike(text.word_pattern(words) if isinstance(words, list) else f"\\b(?:{words})\\b")


def line_features(line: Column, folded: Column, price: Column, vocabulary: dict[str, str | list[str]] | None = None) -> dict[str, Column]:
    """What a line has: a price, a currency, a vintage or NV, words of the vocabularies, numbers. folded and price
    (`money.guide_price`) are the line's own, which the caller computes once."""
    v = {"core": rules.CORE, "producer": rules.PRODUCER, "prestige": rules.PRESTIGE, "kind": rules.KIND} | (vocabulary or {})
    return {
        "priced": price["price_value"].isNotNull(), "has_currency": price["currency"] != "", "has_vintage": line.rlike("\\b(?:19|20)\\d{2}\\b"), "has_nv": line.rlike("(?i)\\bN\\.?V\\.?\\b"),
        **{f"is_{k}": word_test(folded, words) for k, words in v.items()}, "numbers": price["amounts"],
    }


def line_score(line: Column, watched: Column | None = None, vocabulary: dict[str, str | list[str]] | None = None) -> Column:
    """0 for what is no product line, else the additive score of what it has (7 or more, priced, two kinds of evidence)."""
    watched = F.lit(False) if watched is None else watched
    n = lambda test, k: F.when(test, k).otherwise(0)

    def scored(f: Column, folded: Column) -> Column:
        points = n(watched, 5) + n(f["has_vintage"], 2) + n(f["priced"], 3) + n(f["has_currency"], 2) + n(f["is_kind"], 3) + n(f["is_producer"], 3) + n(f["is_prestige"], 3) + n(f["numbers"] >= 2, 1)
        evidence = n(f["is_core"], 1) + n(f["is_producer"], 1) + n(f["is_prestige"], 1) + n(f["has_vintage"] | f["has_nv"], 1)
        context = f["has_currency"] | (f["has_vintage"] | f["has_nv"]) & (f["numbers"] >= 2)
        named = f["is_core"] | f["is_producer"] | f["is_prestige"] | watched
        reject = ~F.length(line).between(8, 260) | folded.rlike(text.part_pattern(rules.BAD_PART)) | word_test(folded, rules.BAD_WORD) | word_test(folded, rules.NOT_PRODUCT) | line.rlike("[_{}<>]|['\"]\\s*:")
        return money.let(points, lambda p: F.when(named & (p >= 7) & f["priced"] & context & (evidence >= 2) & ~reject, p).otherwise(0))

    def featured(x: Column) -> Column:
        return F.struct(*(c.alias(k) for k, c in line_features(line, x["folded"], x["price"], vocabulary).items()))

    facts = F.struct(text.fold(line).alias("folded"), money.guide_price(line).alias("price"))
    return money.let(facts, lambda x: money.let(featured(x), lambda f: scored(f, x["folded"])))


def source_evidence(lines: DataFrame, key: str, line: str = "line", vocabulary: dict[str, str] | None = None) -> DataFrame:
    """Counts of evidence over the distinct lines of each source."""
    count = lambda test: F.sum(F.when(test, 1).otherwise(0))
    once = lines.select(key, line).distinct().withColumns({"_folded": text.fold(line), "_price": money.guide_price(F.col(line))})
    flagged = once.withColumns(line_features(F.col(line), F.col("_folded"), F.col("_price"), vocabulary))
    return flagged.groupBy(key).agg(
        F.count("*").alias("n_lines"), count(F.col("priced")).alias("n_priced"), count(F.col("is_core")).alias("n_core"), count(F.col("is_producer")).alias("n_producer"), count(F.col("is_prestige")).alias("n_prestige"),
        count(F.col("is_kind")).alias("n_kind"), count(F.col("has_vintage") | F.col("has_nv")).alias("n_vintage"), count(F.col("has_currency")).alias("n_currency"))


def source_confidence(e: DataFrame, is_pdf: Column, signal: Column, generic: Column, link_score: Column, event_page: Column | None = None, list_host: Column | None = None) -> DataFrame:
    """score and reason for evidence rows: the first test that fails gives the reason; 120 or more is accepted. A page about an
    event is none whatever it holds."""
    event_page, list_host = (F.lit(False) if c is None else c for c in (event_page, list_host))
    n = {c: F.col(f"n_{c}") for c in ("lines", "priced", "core", "producer", "prestige", "kind", "vintage", "currency")}
    reason = (
        F.when(event_page, "event page").when(n["lines"] < 5, "few lines").when(n["priced"] < 5, "few prices").when((n["core"] < 2) & (n["prestige"] < 1) & (n["producer"] < 3), "weak identity")
        .when((n["vintage"] < 3) & (n["currency"] < 3), "weak vintage").when(generic & ~is_pdf & (n["lines"] < 8), "generic page").when(~signal & (n["lines"] < 8), "no list address")
    )
    add = lambda test, k: F.when(test, k).otherwise(0)
    full = (
        link_score + add(is_pdf, 30) + add(list_host, 80) + add(signal, 40) + F.least(n["lines"], F.lit(10)) * 12 + add(n["lines"] >= 3, 30)
        + add(n["currency"] >= 2, 20) + add(n["vintage"] >= 2, 20) + add(n["core"] >= 1, 45) + add(n["kind"] >= 2, 35)
    )
    score = F.when(event_page, 0).when(reason.isNotNull(), link_score).otherwise(full)
    return e.withColumn("score", score.cast("long")).withColumn("reason", F.coalesce(reason, F.when(full < 120, "low score"), F.lit("")))


def carried_headers(lines: DataFrame, key: str, pos: str, is_header: Column, reach: int) -> DataFrame:
    """Each line with the last header before it in its document, if at most `reach` lines back."""
    w = W.partitionBy(key).orderBy(pos)
    last = F.last(F.when(is_header, F.struct(F.col(pos).alias("at"), F.col("line").alias("header"))), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    return lines.withColumn("h", last).withColumn("header", F.when(F.col(pos) - F.col("h.at") <= reach, F.col("h.header"))).drop("h")


def section_rows(lines: DataFrame, key: str, tokens: list[str], reach: int = 30) -> DataFrame:
    """Rows under a header that has all tokens, until a row that looks like another header: a state machine for each document.

    Rows arrive sorted in documents' order and are handled as a stream, so that a document never has to fit in memory. They are dealt by a hash of the key, which no partitioning of the input can
    stand for: a union of inputs dealt by the key itself need not keep a key together."""

    def machine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = (None, None, 0)
        for pdf in batches:
            out = []
            for k, pos, line, folded, row, header in pdf[[key, "pos", "line", "folded", "is_row", "is_header"]].itertuples(index=False):
                doc, head, left = state
                if doc != k:
                    head, left = None, 0
                if header and all(t in folded for t in tokens):
                    head, left = line, reach
                elif head is not None:
                    if row:
                        out.append((k, pos, f"{head}, {line}"))
                    elif header:
                        head, left = None, 0
                    left -= 1
                    if left <= 0:
                        head = None
                state = (k, head, left)
            yield pd.DataFrame(out, columns=[key, "pos", "text"])

    row = F.col("line").rlike("(?i)\\b(?:NV|MV|N/V|(?:19|20)\\d{2})\\b") & F.col("line").rlike("\\d{2,6}\\s*$")
    header = ~row & (F.length("line") <= 90) & ~F.col("line").rlike("\\d{2}")
    ready = lines.select(key, "pos", "line", text.fold("line").alias("folded"), row.alias("is_row"), header.alias("is_header")).repartition(F.xxhash64(key)).sortWithinPartitions(key, "pos")
    kind = dict(lines.dtypes)[key]
    return ready.mapInPandas(machine, f"`{key}` {kind}, pos int, text string")


def fragments(body: Column, token: str, before: int = 40, after: int = 260) -> Column:
    """Array of the windows around each place of the folded token."""
    folded = text.fold(body)
    pieces = F.split(folded, F.lit("\\Q" + token + "\\E"), F.lit(-1))
    # one pass: each piece ends where the next place is
    nowhere = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places"))
    ended = lambda done, p: F.struct((done.at + F.length(p) + len(token)).alias("at"), F.concat(done.places, F.array(done.at + F.length(p))).alias("places"))
    places = F.aggregate(F.slice(pieces, F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(0))), nowhere, ended, lambda done: done.places)
    found = F.transform(places, lambda p: F.substring(body, F.greatest(F.lit(1), p - before), F.least(p - 1, F.lit(before)) + after))
    return F.when(F.size(pieces) > 1, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))


def probable_row(line: Column) -> Column:
    commas = F.length(line) - F.length(F.replace(line, F.lit(","), F.lit("")))
    return line.rlike("(?i)^(?:NV|MV|N/V|\\d{4})\\b") | ((commas >= 2) & (F.length(line) <= 180))


def product_line(line: Column, structured: Column | bool = False, trusted: Column | bool = False) -> Column:
    """struct(name, vintage, size_ml, price_value, currency) of a shop line, null for what is no product: no evidence term, a
    script, too long, neither price nor vintage, or a sentence without a price."""
    structured, trusted = F.lit(structured) if isinstance(structured, bool) else structured, F.lit(trusted) if isinstance(trusted, bool) else trusted
    clean = F.trim(F.regexp_replace(line, "\\s+", " "))
    folded, words = text.fold(clean), F.size(F.split(clean, " "))
    price, year = money.shop_price(clean), money.shop_vintage(clean)
    priced = price["price_value"].isNotNull()
    evidence = trusted | folded.rlike("|".join(rules.EVIDENCE))
    script = F.lit(False)
    for mark in rules.SCRIPT_MARKS:
        script = script | folded.contains(mark)
    loose = (F.length(clean) > 240) | (words > 38) | script | ~priced & (year == "") | ~priced & (F.length(clean) > 180) | ~priced & (words >= 12) & clean.rlike("[.!?]$")
    fields = F.struct(F.substring(clean, 1, 500).alias("name"), year.alias("vintage"), money.size_ml(clean).alias("size_ml"), price["price_value"].alias("price_value"), price["currency"].alias("currency"))
    return F.when((F.length(clean) >= 5) & evidence & (structured | ~loose), fields)


def embedded_products(html: Column) -> Column:
    """Array of struct(producer, name, vintage, region, price) of the records that pages embed as escaped JSON."""
    plain = F.replace(text.clean_text(html), F.lit('\\"'), F.lit('"'))
    blocks = F.regexp_extract_all(plain, F.lit('(?s)"fields"\\s*:\\s*\\{(.*?)\\}\\s*\\}'), F.lit(1))
    value = lambda b, name: F.regexp_extract(b, f'"(?i:{name})"\\s*:\\s*\\[?\\s*"([^"]*)"', 1)
    records = F.transform(blocks, lambda b: F.struct(
        value(b, "Producer Name|producer").alias("producer"), value(b, "Name").alias("name"), value(b, "Vintage").alias("vintage"), value(b, "Region Name|region").alias("region"),
        F.regexp_extract(b, '"Price"\\s*:\\s*(\\d+(?:\\.\\d+)?)', 1).try_cast("double").alias("price")))
    return F.array_distinct(F.filter(records, lambda r: r["price"] >= 10))


def visible_lines(pieces: DataFrame, key: str, least: int = 80) -> DataFrame:
    """Text pieces (key, pos, line) of a page joined until a line has `least` characters or a price: a stream in order of place."""

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, doc, first = [], None, 0
        last = None
        for pdf in batches:
            out = []
            for k, pos, line, priced in pdf[[key, "pos", "line", "priced"]].itertuples(index=False):
                if doc is not None and k != doc and held:
                    out.append((doc, first, " ".join(held)))
                    held = []
                if not held:
                    first = pos
                doc = k
                held.append(line)
                if priced or sum(map(len, held)) + len(held) - 1 >= least:
                    out.append((doc, first, " ".join(held)))
                    held = []
            last = pd.DataFrame(out, columns=[key, "pos", "text"])
            yield last
        if held:
            yield pd.DataFrame([(doc, first, " ".join(held))], columns=[key, "pos", "text"])

    kind = dict(pieces.dtypes)[key]
    ready = pieces.select(key, F.col("pos").cast("int").alias("pos"), "line", money.shop_price(F.col("line"))["price_value"].isNotNull().alias("priced"))
    return ready.repartition(F.xxhash64(key)).sortWithinPartitions(key, "pos").mapInPandas(join, f"`{key}` {kind}, pos int, text string")


def external_site(links: DataFrame, key: str, own: str) -> DataFrame:
    """Best link (key, href, text) of each page to another site: labelled as website first, then the shortest path; no social hosts."""
    from ..functions import web

    target = F.coalesce(F.nullif(F.url_decode(F.regexp_extract("href", "[?&](?:url|u|target|redirect)=(https?(?:%3A|:)[^&]+)", 1)), F.lit("")), F.col("href"))
    fine = links.withColumn("site", web.normalize_url(target)).where(F.col("href").rlike("^https?://") & (web.domain(F.col("site")) != web.domain(F.col(own))) & ~web.domain(F.col("site")).rlike(text.part_pattern(rules.SOCIAL_HOSTS)))
    score = F.when(F.lower("text").rlike("website|web site|homepage|official"), 0).otherwise(1)
    path = F.length(F.regexp_extract("site", "^[a-z]+://[^/]*(.*)$", 1))
    return fine.groupBy(key).agg(F.min(F.struct(score.alias("s"), path.alias("p"), F.col("site"))).alias("x")).select(key, F.col("x.site").alias("site"))


def best_first(links: DataFrame, pages: int = 60, depth: int = 5) -> DataFrame:
    """Crawl order over a recorded link graph (site, source, url, score; a null source is a start): the open page of the highest
    score is visited next, up to `pages` pages and `depth` links from the start; ties go to the fewest links, then the address.

    All sites take their next page in the same round: the best of each site's open pages is an aggregate, and the graph is asked for the
    links of these pages alone. The open pages are a table that each round writes anew; no task holds a site."""
    spark = links.sparkSession
    graph = shared.stored(links.where("site is not null and url is not null").select("site", "source", "url", (-F.col("score").cast("double")).alias("p")), "crawl-links")
    open_ = shared.stored(graph.where("source is null").select("site", "p", F.lit(0).alias("d"), "url"), "crawl-open")
    visits = []
    for turn in range(1, pages + 1):
        best = open_.groupBy("site").agg(F.min(F.struct("p", "d", "url")).alias("b"))
        now = shared.stored(best.select("site", "b.url", F.lit(turn).alias("turn"), F.col("b.d").alias("depth")), "crawl-visits")
        if now.isEmpty():
            shared.removed(spark, now.stored_at)
            break
        visits.append(now.stored_at)
        seen = spark.read.schema(now.schema).parquet(*visits)
        going = now.where(F.col("depth") < depth).select("site", F.col("url").alias("source"), (F.col("depth") + 1).alias("d"))
        new = graph.join(going, ["site", "source"]).select("site", "p", "d", "url")
        left = open_.unionByName(new).groupBy("site", "url").agg(F.min(F.struct("p", "d")).alias("m")).join(seen.select("site", "url"), ["site", "url"], "left_anti")
        last, open_ = open_, shared.stored(left.select("site", "m.p", "m.d", "url"), "crawl-open")
        shared.removed(spark, last.stored_at)
    shared.removed(spark, open_.stored_at, graph.stored_at)
    empty = spark.createDataFrame([], "site string, url string, turn int, depth int")
    return spark.read.schema(empty.schema).parquet(*visits) if visits else empty
