"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

Writing. A record is a row of Spark's text writer whose line separator is the blank line that ends a record, so archives are
written and committed by Spark itself, on any file system that it knows and whatever executors are lost (the files end in
.txt; what they hold is WARC). Of records with equal payloads (by SHA-1 and length) of at least `least` bytes, that with
the smallest id is a response, the others are revisits of it without the payload.

Reading. Spark's text reader cuts archives at the magic "WARC/1.", in as many tasks as it splits the files into. The magic has
no border, so the cuts are the same wherever a split begins, and no byte is lost: the place of a piece is the sum of what
comes before it, summed within a split, then over a file's splits. A piece that starts with a whole WARC header is a
candidate, whose successor's offset its Content-Length gives. Within a split numpy follows the successors to the first offset
beyond the split; over splits offsets jump by doubling, from the file's start, in joins of narrow rows, as many rounds as
the logarithm of a file's splits. Only what the chain reaches is a record: a magic inside a payload, with a perfect header
or not, is never reached, because the record around it steps over it. Payloads in which the magic occurs are put together
again from their pieces; all others are digested where they are read.

Memory: a task holds one piece's bytes at a time and 24 bytes for each candidate of a split.

Edge cases: a null payload is empty; payloads of `least` bytes and more are compared, empty ones as well where that is 0; rows
of equal smallest id and payload are all responses, as nothing tells them apart; a null id comes after all others; a null
URL has no field; characters that would break a header line are percent-encoded; a table without rows gives an archive
without records. Of a file whose chain breaks (no record where one should begin) the records up to there are returned, the
last one with intact false if bytes are missing.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, removed, shared_dir, stored, table
from .textbatch import grouped

MAGIC = "WARC/1."
BLANK = "\r\n\r\n"
#: WARC asks for a date in each record; pages have none.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A longer header is none.
HEADER = 1 << 16
_FIELDS = {"warc_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "declared": "WARC-Payload-Digest", "content_type": "Content-Type"}
_CARRIED = [*_FIELDS, "head", "content", "sha1", "payload_bytes", "http_bytes"]


def base32(hexadecimal: Column) -> Column:
    """A SHA-1 in hexadecimal as upper-case base32."""
    parts = [F.lpad(F.conv(F.substring(hexadecimal, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _name(number: Column, digest: Column) -> Column:
    """A record's id: the same in every run, and that of a revisited record is known without reading it."""
    return F.concat(F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(number.cast("string"))), F.lit("<urn:nopage")), F.lit(":"), digest, F.lit(">"))


def page_number(record_id: Column) -> Column:
    """The id of the row that a record was written from; null if it had none."""
    return F.url_decode(F.nullif(F.regexp_extract(record_id, "^<urn:page:([^:>]*):", 1), F.lit("")))


def _line(name: str, value: Column) -> Column:
    """A header line; none for null."""
    unbroken = F.regexp_replace(F.regexp_replace(value, "\r", "%0D"), "\n", "%0A")
    return F.coalesce(F.concat(F.lit(f"{name}: "), unbroken, F.lit("\r\n")), F.lit(""))


def write_warc(pages: DataFrame, path: str, number: str = "page_id", uri: str = "url", payload: str = "html", least: int = 0) -> None:
    """Writes a record for each row of pages to archives in the folder `path`, which must not exist."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(number).alias("number"), F.col(uri).cast("string").alias("uri"), body.alias("body")).withColumns({"sha1": F.sha1("body"), "size": F.octet_length("body").cast("long")})
    with Scratch() as s:
        equal = rows.where(F.col("size") >= least).groupBy("sha1", "size").agg(F.count("*").alias("n"), F.min("number").alias("first")).where("n > 1 and first is not null")
        first = s.stored(equal.select("sha1", "size", "first"), "warc-first")
        all_ = rows.join(first, ["sha1", "size"], "left").withColumns({"digest": base32(F.col("sha1")), "again": F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("number"))})
        http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BLANK))
        framed = all_.withColumn("http", http)
        head = F.concat(
            F.lit(f"{MAGIC}1\r\n"), _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")), _line("WARC-Record-ID", _name(F.col("number"), F.col("digest"))),
            _line("WARC-Date", F.lit(DATE)), _line("WARC-Target-URI", F.col("uri")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
            F.when(F.col("again"), F.concat(_line("WARC-Profile", F.lit(PROFILE)), _line("WARC-Refers-To", _name(F.col("first"), F.col("digest"))))).otherwise(""),
            _line("Content-Type", F.lit("application/http;msgtype=response")), F.lit("Content-Length: "),
            (F.octet_length("http") + F.when(F.col("again"), 0).otherwise(F.col("size"))).cast("string"), F.lit(BLANK),
        )
        record = F.concat(head, F.col("http"), F.when(F.col("again"), "").otherwise(F.col("body").cast("string")))
        framed.select(record.alias("record")).write.option("lineSep", BLANK).text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What lies between two magics, in the order of each split; value has no magic."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value", F.octet_length("value").cast("long").alias("size"))


def _headed(pieces: DataFrame) -> DataFrame:
    """With what a candidate's header says, and its payload's SHA-1 and length if the piece has all of it; null for no candidate."""
    cut = pieces.withColumn("h", F.substring_index("value", BLANK, 1)).withColumn("head", F.octet_length("h").cast("long") + 4)
    named = F.col("h").rlike(r"^\d\r\n[!-9;-~]+:") & ~F.col("h").rlike(r"\r\n(?:[!-9;-~]*[^!-9;-~:]|:|\z)")
    sound = (F.col("head") <= F.least(F.col("size"), F.lit(HEADER))) & named
    read = cut.withColumn("h", F.when(sound, F.col("h")))
    field = lambda name: F.nullif(F.trim(F.regexp_extract("h", rf"(?i)\r\n{name}:([^\r\n]*)", 1)), F.lit(""))
    read = read.withColumn("content", F.when(field("Content-Length").rlike(r"^\d{1,15}$"), field("Content-Length").cast("long")))
    read = read.withColumns({c: F.when(F.col("content").isNotNull(), field(name)) for c, name in _FIELDS.items()})
    whole = F.when(F.col("content").isNotNull() & (F.col("head") + F.col("content") <= F.col("size")), F.substring(F.col("value").cast("binary"), (F.col("head") + 1).cast("int"), F.col("content").cast("int")))
    return _digested(read.withColumn("block", whole))


def _digested(records: DataFrame) -> DataFrame:
    """block gives way to the payload's SHA-1 and length and the length that its HTTP header tells."""
    http = F.when(F.lower("content_type").startswith("application/http"), F.substring_index(F.col("block").cast("string"), BLANK, 1))
    rows = records.withColumn("http", http).withColumn("payload", F.when(F.col("http").isNull(), F.col("block")).otherwise(F.substring(F.col("block"), (F.octet_length("http") + 5).cast("int"), F.octet_length("block"))))
    told = F.regexp_extract("http", r"(?i)\r\nContent-Length:[ \t]*(\d{1,15})[ \t]*(?:\r\n|$)", 1)
    return rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long"), "http_bytes": F.nullif(told, F.lit("")).cast("long")})


def _exits(start: np.ndarray, after: np.ndarray, end: int) -> np.ndarray:
    """For each candidate of a split the first offset on its chain at or beyond end; -1 where the chain meets no candidate.

    start ascends, and all jump at once, by doubling."""
    to = np.searchsorted(start, after)
    found = (to < len(start)) & (start[np.minimum(to, len(start) - 1)] == after)
    last = np.where(found, 0, np.where(after >= end, after, -1))
    jump = np.where(found, to, np.arange(len(start)))
    while True:
        further = jump[jump]
        if (further == jump).all():
            return last[jump]
        jump = further


def _placed(schema: pa.Schema):
    """Rows of a split get `local`, their magic's offset against the split's first piece; then, as rows of their own, the chain of its
    candidates (kind 1: local, after, out) and what the split holds in all (kind 2: local)."""

    def row(key, kind, **columns):
        n = len(next(iter(columns.values())))
        given = {"file": pa.array([key[0]] * n, pa.string()), "split": pa.array([key[1]] * n, pa.int64()), "kind": pa.array([kind] * n, pa.int32())} | {k: pa.array(v, pa.int64()) for k, v in columns.items()}
        return pa.record_batch([given.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    def each(batches):
        key, total, starts, afters = None, 0, [], []

        def ended():
            start, after = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, afters))
            if len(start):
                yield row(key, 1, local=start, after=after, out=_exits(start, after, total - len(MAGIC)))
            yield row(key, 2, local=[total])

        for batch in batches:
            files, splits = batch.column("file").dictionary_encode(), batch.column("split").to_numpy()
            code = files.indices.to_numpy()
            cuts = [0, *(np.flatnonzero((code[1:] != code[:-1]) | (splits[1:] != splits[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                here = (files.dictionary[int(code[a])].as_py(), int(splits[a]))
                opens = here != key
                if opens:
                    if key is not None:
                        yield from ended()
                    key, total, starts, afters = here, 0, [], []
                size = part.column("size").to_numpy()
                local = total + np.cumsum(size + len(MAGIC)) - size - 2 * len(MAGIC)
                total += int((size + len(MAGIC)).sum())
                content = part.column("content")
                real = np.asarray(content.is_valid())
                if opens and key[1] == 0:
                    real = real.copy()
                    real[0] = False  # what comes before a file's first magic
                after = local + len(MAGIC) + part.column("head").to_numpy() + np.asarray(content.fill_null(0)) + len(BLANK)
                starts.append(local[real])
                afters.append(after[real])
                own = {"kind": pa.array(np.zeros(b - a, np.int32)), "local": pa.array(local), "after": pa.array(np.where(real, after, 0), mask=~real), "out": pa.nulls(b - a, pa.int64())}
                yield pa.record_batch([own[f.name] if f.name in own else part.column(f.name).cast(f.type) for f in schema], schema=schema)
        if key is not None:
            yield from ended()

    return each


def _walked(batches):
    """Of each split's candidates those on the chain from its entry."""
    for rows in grouped(batches, ["file", "split"]):
        start, after, entry = (rows.column(c).to_numpy() for c in ("start", "after", "entry"))
        place, kept = {int(s): k for k, s in enumerate(start.tolist())}, []
        k = place.get(int(entry[0]))
        while k is not None:
            kept.append(k)
            k = place.get(int(after[k]))
        yield from rows.select(["file", "split", "start"]).take(pa.array(kept, pa.int64())).combine_chunks().to_batches()


def _entries(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(file, start) of the first record of every split that has one: reached from offset 0 by jumps from split to split.

    links: (file, start, out) of all candidates. After k rounds all within 2**k jumps are known."""
    known = scratch.stored(links.where("start = 0").select("file", "start"), "warc-known")
    entered = links.where("out >= 0").select("file", F.col("out").alias("start")).distinct()
    # only what some split's chain leads to can be jumped to
    hop = links.where("out >= 0").join(entered.unionByName(known).distinct().hint("merge"), ["file", "start"], "left_semi")
    hop = scratch.stored(hop.join(entered.withColumnRenamed("start", "out").hint("merge"), ["file", "out"], "left_semi").select("file", "start", "out"), "warc-hop")
    while True:
        new = scratch.stored(known.join(hop.hint("merge"), ["file", "start"]).select("file", F.col("out").alias("start")), "warc-new")
        if new.isEmpty():
            return known
        last, known = known, scratch.stored(known.unionByName(new).distinct(), "warc-known")
        further = hop.select("file", F.col("start").alias("out"), F.col("out").alias("beyond"))
        old, hop = hop, scratch.stored(hop.join(further.hint("merge"), ["file", "out"]).select("file", "start", F.col("beyond").alias("out")), "warc-hop")
        scratch.drop(last, new, old)


def _owned(segments: DataFrame, records: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, split, local, at, owner) of the pieces of the given records (file, split, start, after): a record's own and all up to
    its end, in its split and in those that it goes on into."""
    pieces = segments.select("file", "split", (F.col("base") + F.col("local")).alias("at"), "local", F.lit(None).cast("long").alias("owner"), F.lit(None).cast("long").alias("till"))
    mark = ["file", "split", "at", F.lit(None).cast("long").alias("local"), F.col("start").alias("owner"), F.col("after").alias("till")]
    own = records.withColumn("at", F.col("start")).select(mark)
    # splits that begin inside a record: as many as its length holds
    on = records.drop("split").join(starts, "file").where("base - 7 > start and base - 7 < after").withColumn("at", F.col("base") - 8).select(mark)
    order = W.partitionBy("file", "split").orderBy("at", F.col("local").isNotNull())
    filled = pieces.unionByName(own).unionByName(on).withColumns({c: F.last(c, ignorenulls=True).over(order) for c in ("owner", "till")})
    return filled.where("local is not null and at < till").select("file", "split", "local", "at", "owner")


def _local(schema: pa.Schema):
    """The pieces' bytes with their place in the split, as `_placed` counts."""

    def each(batches):
        key, total = None, 0
        for batch in batches:
            for k in range(batch.num_rows):
                here = (batch.column("file")[k].as_py(), batch.column("split")[k].as_py())
                total = total if here == key else 0
                key, size = here, batch.column("size")[k].as_py()
                yield pa.record_batch([pa.array([here[0]]), pa.array([here[1]]), pa.array([total - len(MAGIC)]), batch.column("value").slice(k, 1)], schema=schema)
                total += size + len(MAGIC)

    return each


def _blocks(spark: SparkSession, path: str, owned: DataFrame, records: DataFrame) -> DataFrame:
    """The records with block, their content, put together from their pieces."""
    schema = "file string, split long, local long, value binary"
    arrow = pa.schema([("file", pa.string()), ("split", pa.int64()), ("local", pa.int64()), ("value", pa.binary())])
    bytes_ = _pieces(spark, path).withColumn("value", F.col("value").cast("binary")).select("file", "split", "value", "size").mapInArrow(_local(arrow), schema)
    mine = bytes_.join(owned.hint("merge"), ["file", "split", "local"]).groupBy("file", F.col("owner").alias("start")).agg(F.sort_array(F.collect_list(F.struct("at", "value"))).alias("p"))
    joined = F.reduce(F.slice("p", 2, F.size("p")), F.col("p")[0]["value"], lambda done, p: F.concat(done, F.lit(MAGIC.encode()), p["value"]))
    cut = F.substring(joined, (F.col("head") + 1).cast("int"), F.col("content").cast("int"))
    return records.join(mine.hint("merge"), ["file", "start"]).withColumn("block", cut).drop("p")


def read_warc(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """A row for each record of the archives in a folder: file, start (offset), warc_type, record_id, target_uri, date, refers_to,
    content_type, declared (its digest field), digest (of the payload's bytes as found, base32), payload_bytes, http_bytes (the
    length that its HTTP header tells), intact (nothing missing, and the digest as declared unless it is a revisit), and
    with `payload` the payload. A table that stays in the shared folder."""
    kinds = {"head": "long", "content": "long", "payload_bytes": "long", "http_bytes": "long"}
    columns = ", ".join(["file string, split long, kind int, local long, size long, after long, out long", *(f"{c} {kinds.get(c, 'string')}" for c in _CARRIED)])
    arrow = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in columns.split(", ")])
    with Scratch() as s:
        scanned = s.stored(_headed(_pieces(spark, path)).select("file", "split", "size", *_CARRIED).mapInArrow(_placed(arrow), columns), "warc-scanned")
        upto = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)  # over a file's splits
        starts = s.stored(scanned.where("kind = 2").select("file", "split", F.coalesce(F.sum("local").over(upto), F.lit(0)).alias("base")), "warc-splits")
        based = scanned.join(starts.hint("merge"), ["file", "split"])
        beyond = F.when(F.col("out") >= 0, F.col("base") + F.col("out"))
        links = s.stored(based.where("kind = 1").select("file", "split", (F.col("base") + F.col("local")).alias("start"), (F.col("base") + F.col("after")).alias("after"), beyond.alias("out")), "warc-links")
        entries = _entries(links, s).join(links.select("file", "start", "split").hint("merge"), ["file", "start"]).select("file", "split", F.col("start").alias("entry"))
        walk = links.select("file", "split", "start", "after").join(entries.hint("merge"), ["file", "split"])
        found = s.stored(walk.repartition("file", "split").sortWithinPartitions("file", "split", "start").mapInArrow(_walked, "file string, split long, start long"), "warc-reached")
        read = based.where("kind = 0 and content is not null").withColumns({"start": F.col("base") + F.col("local"), "after": F.col("base") + F.col("after")})
        records = s.stored(read.join(found.select("file", "start").hint("merge"), ["file", "start"], "left_semi").select("file", "split", "start", "after", *_CARRIED), "warc-records")
        apart = records if payload else records.where("sha1 is null")
        whole = records.where("sha1 is not null").withColumn("payload", F.lit(None).cast("binary"))
        if not apart.isEmpty():
            owned = _owned(based.where("kind = 0").select("file", "split", "local", "base"), apart.select("file", "split", "start", "after"), starts)
            again = _digested(_blocks(spark, path, owned, apart)).select(*whole.columns)
            whole = again if payload else whole.unionByName(again)
        digest = base32(F.col("sha1"))
        sound = F.coalesce(F.when(F.col("warc_type") == "revisit", F.lit(True)), F.col("payload_bytes") == F.coalesce("http_bytes", "content"), F.lit(False))
        same = F.col("declared").isNull() | (F.col("warc_type") == "revisit") | (F.lower("declared") == F.lower(F.concat(F.lit("sha1:"), digest)))
        out = whole.select("file", "start", *_FIELDS, digest.alias("digest"), "payload_bytes", "http_bytes", (sound & same).alias("intact"), *(["payload"] if payload else []))
        return stored(out, "warc-read")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/tastevin/warc-{uuid.uuid4().hex}"
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    records = read_warc(spark, path)
    removed(path, spark=spark)
    again = F.col("warc_type") == "revisit"
    return records.select(
        page_number(F.col("record_id")).cast("long").alias("page_id"), F.when(again, F.col("http_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(again, F.regexp_replace("declared", "^sha1:", "")).otherwise(F.col("digest")).alias("payload_digest"), F.col("warc_type").alias("record_type"),
        F.when(again, page_number(F.col("refers_to")).cast("long")).alias("refers_to"),
    )


SQL = """
with p as (select page_id, coalesce(html, '') as html, min(page_id) over (partition by coalesce(html, '')) as first from pages), h as (select *, sha1(html) as h, first is not null and page_id is distinct from first as again from p)
select page_id, strlen(html) as payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * (k // 4) + 1, 5))::int // (1 << (15 - 5 * (k % 4)))::int) % 32 + 1, 1)), '') as payload_digest,
    case when again then 'revisit' else 'response' end as record_type, case when again then first end as refers_to
from h
"""
