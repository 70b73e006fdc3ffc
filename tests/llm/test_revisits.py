import gzip
import random
from collections import Counter

from pyspark.sql import functions as F

from strandlake.llm import revisits as rv


def test_as_of_join_matches_a_plain_loop(spark):
    random.seed(7)
    rows = []
    for i in range(300):
        url = random.choice(["http://www.A.com/x?utm_source=1", "https://a.com/x#f", "http://b.org/", None, "http://hot.net/p", "http://hot.net/p/", "http://hot.net/p"])
        kind = random.choice(["response", "revisit", "request"])
        headers = {k: str(random.randrange(2)) for k in ("etag", "last-modified", "content-type", "cache-control") if random.random() < 0.6}
        rows.append((i, kind, url, random.choice([None, *range(60)]) if random.random() < 0.9 else 10, headers or None))
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, sec long, headers map<string,string>").withColumn("date", F.timestamp_seconds("sec")).drop("sec")
    canon = {r["record_id"]: r["c"] for r in df.select("record_id", rv.canonical_url(F.col("url")).alias("c")).collect()}
    for spans in (1, 7, 64):
        got = {r["record_id"]: r for r in rv.resolve(df, spans).collect()}
        assert set(got) == {r[0] for r in rows if r[1] == "revisit"}
        for i, kind, _, sec, headers in rows:
            if kind != "revisit":
                continue
            headers = headers or {}
            earlier = [(s, j, h or {}) for j, k, _, s, h in rows if k == "response" and canon[j] == canon[i] and s is not None and sec is not None and s < sec]
            r = got[i]
            if not earlier:
                assert r["status"] == "missing" and r["response_id"] is None
                continue
            _, j, stored = max(earlier, key=lambda e: e[:2])
            assert r["response_id"] == j
            same = headers["etag"] == stored["etag"] if "etag" in headers and "etag" in stored else headers["last-modified"] == stored["last-modified"] if "last-modified" in headers and "last-modified" in stored else None
            assert r["status"] == ("unchecked" if same is None else "resolved" if same else "changed")
            if same is not False:
                assert r["headers"] == {**stored, **{k: v for k, v in headers.items() if k in rv.MERGED}}
            else:
                assert (r["headers"] or {}) == headers


def test_canonical_urls(spark):
    cases = {"HTTP://WWW.Ex.com/A?b=1&utm_source=x#f": "ex.com/A?b=1", "https://ex.com/?ref=q": "ex.com", "http://ex.com/a?utm_medium=1&b=2": "ex.com/a?b=2", None: "", "": "", "ex.com/p/": "ex.com/p"}
    df = spark.createDataFrame([(u,) for u in cases], "u string").select("u", rv.canonical_url(F.col("u")).alias("c"))
    assert {r["u"]: r["c"] for r in df.collect()} == cases


def test_files_round_trip(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nETag: \"a\"\r\nContent-Type: text/html\r\n\r\n<html>\xff\x00body</html>"
    back = b"HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\nDate: later\r\n\r\n"
    for compress in (True, False):
        data = rv.write_record("warcinfo", "", "2024-01-01T00:00:00Z", "<i>", b"software: x", compress)
        data += rv.write_record("response", "http://a.com/", "2024-01-01T00:00:00Z", "<1>", http, compress) + rv.write_record("revisit", "http://a.com/", "2024-01-02T00:00:00Z", "<2>", back, compress)
        (tmp_path / f"f{compress}.warc").write_bytes(data)
    rows = rv.read_warc(spark, str(tmp_path)).orderBy("warc_id").collect()
    assert [(r["warc_id"], r["kind"], r["http_status"]) for r in rows] == [("<1>", "response", 200)] * 2 + [("<2>", "revisit", 304)] * 2
    assert bytes(rows[0]["body"]) == b"<html>\xff\x00body</html>" and rows[0]["headers"]["etag"] == '"a"'
    records = rv.read_warc(spark, str(tmp_path / "fTrue.warc")).select(F.when(F.col("kind") == "response", 1).otherwise(2).cast("long").alias("record_id"), "kind", "url", F.to_timestamp("date").alias("date"), "headers", "body")
    out = rv.with_bodies(rv.resolve(records), records).first()
    assert out["status"] == "resolved" and out["response_id"] == 1 and out["headers"]["content-type"] == "text/html" and out["headers"]["date"] == "later" and bytes(out["body"]).endswith(b"</html>")


def test_damaged_files_give_their_good_records(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody"
    good = lambda i, z: rv.write_record("response", "http://a.com/", "2024-01-01T00:00:00Z", f"<{i}>", http, z)
    (tmp_path / "cut.warc.gz").write_bytes(good(1, True) + good(2, True)[:-30])
    (tmp_path / "noise.warc.gz").write_bytes(good(3, True) + b"\x1f\x8bnoise" * 9)
    (tmp_path / "length.warc").write_bytes(good(4, False) + good(5, False).replace(b"Content-Length: ", b"Content-Length: x") + good(6, False))
    (tmp_path / "short.warc").write_bytes(good(7, False) + good(8, False)[:-6])
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = rv.read_warc(spark, str(tmp_path)).collect()
    assert sorted(r["warc_id"] for r in rows if r["kind"] == "response") == ["<1>", "<3>", "<4>", "<6>", "<7>"]
    assert sum(r["kind"] == rv.DAMAGED for r in rows) == 4


def test_bad_lengths_cost_their_own_record_only(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\n\r\nbody with WARC words"
    good = lambda i: rv.write_record("response", "http://a.com/", "2024-01-01T00:00:00Z", f"<{i}>", http, False)
    size = b"Content-Length: " + str(len(http)).encode()
    for n, wrong in enumerate([len(http) + 40, len(http) + len(good(2)) + 7, len(http) + 4, len(http) - 3, 0, 10**6, 10**13, 10**20, -1]):
        bad = good(2).replace(size, b"Content-Length: " + str(wrong).encode())
        records = [good(1), bad, good(3), good(4)]
        (tmp_path / f"p{n}.warc").write_bytes(b"".join(records))
        (tmp_path / f"z{n}.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records))
        (tmp_path / f"one{n}.warc.gz").write_bytes(gzip.compress(b"".join(records)))
        (tmp_path / f"last{n}.warc").write_bytes(b"".join([good(1), good(3), good(4), bad]))
    rows = rv.read_warc(spark, str(tmp_path)).collect()
    files = 4 * 9
    assert Counter(r["warc_id"] for r in rows if r["kind"] == "response") == {"<1>": files, "<3>": files, "<4>": files}
    assert sum(r["kind"] == rv.DAMAGED for r in rows) == files
    assert {bytes(r["body"]) for r in rows if r["kind"] == "response"} == {b"body with WARC words"}


def test_members_that_do_not_decompress_lie_between_good_ones():
    good = lambda i: rv.write_record("response", "u", "d", f"<{i}>", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(range(256)) * 9)
    broken = bytearray(good(2))
    broken[len(broken) // 2] ^= 0xFF
    for middle in (bytes(broken), good(2)[:-20], b"\x1f\x8b\x08" + b"x" * 50, b"noise", bytes(broken) * 2):
        ids = [h.get("warc-record-id", h["warc-type"]) for h, _ in rv.parse_warc(good(1) + middle + good(3) + b"\0" * 64)]
        assert ids[0] == "<1>" and ids[-1] == "<3>" and ids.count(rv.DAMAGED) in (0, 1) and set(ids) <= {"<1>", "<2>", "<3>", rv.DAMAGED}, ids
        assert rv.DAMAGED in ids
    # A block that reads like records is a block.
    inner = b"HTTP/1.1 200 OK\r\n\r\n" + rv.write_record("response", "v", "d", "<inner>", b"x", False)
    whole = rv.write_record("response", "u", "d", "<outer>", inner, False) + rv.write_record("response", "u", "d", "<next>", b"y", False)
    assert [(h["warc-record-id"], len(b)) for h, b in rv.parse_warc(whole)] == [("<outer>", len(inner)), ("<next>", 1)]


def test_only_complete_responses_are_stored_ones(spark):
    rows = [(1, "response", "u", 10, {"etag": "a"}, 200, "x"), (2, "response", "u", 20, {"etag": "a"}, 404, "x"), (3, "response", "u", 30, {"etag": "a"}, None, "x"), (4, "revisit", "u", 40, {"etag": "a"}, 304, "x"), (4, "revisit", "u", 40, {"etag": "a"}, 304, "x")]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, sec long, headers map<string,string>, http_status int, canonical string").withColumn("date", F.timestamp_seconds("sec"))
    assert [(r["record_id"], r["response_id"], r["status"], r["canonical"]) for r in rv.resolve(df).collect()] == [(4, 1, "resolved", "u")] * 2
    assert [r["response_id"] for r in rv.resolve(df.drop("http_status")).collect()] == [3, 3]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert rv.resolve(rv.captures_of_pages(pages)).count() == 0
