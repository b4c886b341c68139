"""Archives written, read back over splits of any size, and compared with the rows that they were written from."""

import base64
import hashlib
import random

import numpy as np
import pytest

from tastevin.llm import warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def wanted(rows, least=0):
    first = {}
    for number, _, body in rows:
        if number is not None and len(body or b"") >= least:
            first[body or b""] = min(first.get(body or b"", number), number)
    out = []
    for number, _, body in rows:
        body = body or b""
        lead = first.get(body)
        again = lead is not None and number != lead
        out.append((number, len(body), b32(body), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=repr)


HOSTILE = [
    b"", None, b"WARC/1.0\r\n", b"WARC/1.", b"WARC/1.WARC/1.", b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99:X>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n",
    b"a\r\n\r\nWARC/1.1\r\nContent-Length: 0\r\n\r\n\r\n\r\nb", b"x\r\n", b"x\r\n\r\n", b"\r\n\r\n\r\nx", b"\r\n", b"WARC/1", b"WARC", b"\xff\xfe\x00WARC/1.1\r\n\x80", b"line\nline\rline", b"WARC/1.1\r\nContent-Length: 999999\r\n\r\n" * 7,
    "Größe naïve 漢字".encode(), b"WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 3 + b"z" * 4000 + b"WARC/1.1\r\n",
]


def hostile_rows():
    rng = random.Random(4)
    rows = [(k, f"http://a.example/{k}", body) for k, body in enumerate(HOSTILE)]
    rows += [(100 + k, None if k % 7 == 0 else "http://b.example/x\r\nContent-Length: 3", body) for k, body in enumerate(HOSTILE)]
    rows += [(None, "u", b"alone"), (None, "u", b""), (5, "u", b"x\r\n"), (2, "same", b"repeated"), (2, "same", b"repeated")]
    pieces = [b"WARC/1.", b"\r\n", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 7\r\n\r\n", b"abc", b"W", b"WARC", b"1.0"]
    return rows + [(1000 + k, "u", b"".join(rng.choice(pieces) for _ in range(rng.randint(0, 60)))) for k in range(40)]


def result(records):
    out = []
    for r in records:
        again = r["warc_type"] == "revisit"
        out.append((r["n"], r["http_bytes"] if again else r["payload_bytes"], r["declared"][5:] if again else r["digest"], r["warc_type"], r["of"]))
    return sorted(out, key=repr)


def with_numbers(records):
    return records.withColumns({"n": warc.page_number(records["record_id"]).cast("long"), "of": warc.page_number(records["refers_to"]).cast("long")})


@pytest.mark.parametrize("split", [2503, 10_000_000])
def test_round_trip(spark, tmp_path, split):
    rows = hostile_rows()
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary").repartition(2)
    path = str(tmp_path / "archives")
    warc.write_warc(pages, path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        got = with_numbers(warc.read_warc(spark, path, payload=True)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert result(got) == wanted(rows)
    assert all(r["intact"] for r in got)
    bodies = {(n, body or b"") for n, _, body in rows}
    assert {(r["n"], bytes(r["payload"])) for r in got if r["warc_type"] == "response"} <= bodies
    assert {r["target_uri"] for r in got} >= {None, "http://b.example/x%0D%0AContent-Length: 3"}


def test_without_payload_and_least(spark, tmp_path):
    rows = hostile_rows()
    path = str(tmp_path / "archives")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html binary"), path, least=3)
    assert result(with_numbers(warc.read_warc(spark, path)).collect()) == wanted(rows, 3)


def test_foreign_archive_with_a_broken_chain(spark, tmp_path):
    record = lambda k, body, told=None: b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:%d>\r\ncontent-length:  %d\r\n\r\n%s\r\n\r\n" % (k, len(body) if told is None else told, body)
    (tmp_path / "good.warc").write_bytes(record(1, b"one") + record(2, b"WARC/1.0\r\n") + record(3, b""))
    (tmp_path / "broken.warc").write_bytes(record(4, b"four") + record(5, b"five", told=3) + record(6, b"six"))
    (tmp_path / "short.warc").write_bytes(record(7, b"seven") + record(8, b"eight", told=500))
    (tmp_path / "none.warc").write_bytes(b"no archive WARC/1.0\r\nContent-Length: 1\r\n\r\nx")
    (tmp_path / "empty.warc").write_bytes(b"")
    got = {r["record_id"][7:-1]: r for r in warc.read_warc(spark, str(tmp_path), payload=True).collect()}
    assert sorted(got) == ["1", "2", "3", "4", "5", "7", "8"]
    assert [bytes(got[k]["payload"]) for k in "12347"] == [b"one", b"WARC/1.0\r\n", b"", b"four", b"seven"]
    assert [got[k]["intact"] for k in "12378"] == [True, True, True, True, False]


def test_no_rows(spark, tmp_path):
    path = str(tmp_path / "archives")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_warc(spark, path).collect() == []


def test_exits_of_a_split():
    start, after = np.array([0, 10, 20, 30, 45]), np.array([20, 30, 45, 33, 90])
    assert warc._exits(start, after, 60).tolist() == [90, -1, 90, -1, 90]


def test_jumps_meet_a_walk(spark):
    rng = random.Random(2)
    links, want = [], set()
    for file in "abc":
        starts = sorted(rng.sample(range(1, 5000), 300))
        chain = [0, *sorted(rng.sample(starts, 40))]
        want |= {(file, s) for s in chain}
        links += [(file, s, e) for s, e in zip(chain, [*chain[1:], 9000], strict=True)]
        links += [(file, s, rng.choice([-1, *starts])) for s in starts if s not in chain]
    with warc.Scratch() as scratch:
        got = warc._entries(spark.createDataFrame(links, "file string, start long, out long"), scratch).collect()
    assert {tuple(r) for r in got if r['start'] < 9000} == want  # where a file ends is no candidate


def test_query(spark, tmp_path):
    rows = [(3, "u", "same"), (1, "u", "same"), (2, None, None), (9, "v", ""), (None, None, "WARC/1.1\r\nContent-Length: 2\r\n\r\nab")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = sorted((tuple(r) for r in warc.op12_warc(spark, str(tmp_path)).collect()), key=repr)
    assert got == wanted([(n, u, None if b is None else b.encode()) for n, u, b in rows])
