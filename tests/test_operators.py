"""Core operators against brute force and on awkward input."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from skeinlake.functions import stamps, urls
from skeinlake.functions.instants import days_from_civil, parse_instant
from skeinlake.operators import checks, index, pages
from skeinlake.operators.instants import date_texts, nonconforming_instants, normalise_instants
from skeinlake.operators.ordered import numbered, running_offset, with_previous
from skeinlake.operators.orphans import orphan_counts, orphan_references
from skeinlake.operators.skew import heavy_keys, key_statistics

T = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
MEMBERS = "member_id long, package_id string, path string, listed_at timestamp_ntz, removed_at timestamp_ntz, seen_at string"
CAPTURES = "capture_id long, package_id string, index_path string, seen_at timestamp_ntz, path string"
RESOURCES = "resource_id long, package_id string, path string, seen_at timestamp_ntz"
BLOCKS = "block_id long, package_id string, data_path string, seen_at timestamp_ntz"


def brute_orphans(members, refs):
    out = []
    for i, package, path, seen in refs:
        if path is None:
            continue
        path = "/".join(s for s in path.split("/") if s not in ("", "."))
        own = [(a, b) for _, p, q, a, b, *_ in members if p == package and q == path and p is not None]
        listed = [x for x in own if seen is not None and x[0] is not None and x[0] <= seen]
        if any(b is None or b > seen for _, b in listed):
            continue
        out.append((i, "missing" if not own else "deleted" if listed else "late"))
    return sorted(out)


def test_orphans_against_brute_force(spark):
    rng = random.Random(1)
    paths = ["a/b", "a//b", "./a/b", "a/B", "c", "", None, "x/" * 5000]
    members = [(i, rng.choice(["p", "q", None]), rng.choice(["a/b", "c", "d"]), T(rng.randrange(20)), None, "clash") for i in range(30)]
    members = [m[:4] + (m[3] + dt.timedelta(hours=rng.randrange(1, 9)) if rng.random() < 0.7 else None, "clash") for m in members]
    members += members[:5]
    refs = [(i, rng.choice(["p", "q", "r", None]), rng.choice(paths), rng.choice([T(rng.randrange(30)), None])) for i in range(300)]
    refs += [(1000 + i, "p", "a/b", T(i % 30)) for i in range(600)]  # one key owns most references
    empty = {"zipnum_blocks": spark.createDataFrame([], BLOCKS), "resources": spark.createDataFrame([], RESOURCES)}
    captures = spark.createDataFrame([(*r, "clash") for r in refs], CAPTURES)
    found = orphan_references(spark.createDataFrame(members, MEMBERS), {"captures": captures, **empty})
    assert sorted((r["row_id"], r["reason"]) for r in found.collect()) == brute_orphans(members, refs)
    counts = orphan_counts(found)
    assert counts.agg(F.sum("orphans")).first()[0] == found.count()


def test_orphans_of_nothing(spark):
    empty = {"captures": spark.createDataFrame([], CAPTURES), "zipnum_blocks": spark.createDataFrame([], BLOCKS), "resources": spark.createDataFrame([(1, "p", "a", T(1))], RESOURCES)}
    none = spark.createDataFrame([], MEMBERS)
    assert [tuple(r)[:3] for r in orphan_references(none, empty).collect()] == [("resources", 1, "missing")]


def us(*a, **k):
    return int((dt.datetime(*a, **k) - dt.datetime(1970, 1, 1)).total_seconds()) * 1_000_000


@pytest.mark.parametrize(("text", "zone", "want"), [
    ("2024-05-01T10:00:00Z", None, us(2024, 5, 1, 10)), (" 2024-05-01t10:00:00.1234567z ", None, us(2024, 5, 1, 10) + 123456),
    ("2024-05-01T10:00:00", "Europe/Berlin", us(2024, 5, 1, 8)), ("2024-05-01", "Asia/Kolkata", us(2024, 4, 30, 18, 30)),
    ("20240501100000", "Asia/Tokyo", us(2024, 5, 1, 10)), ("20240501100000123", None, us(2024, 5, 1, 10) + 123000), ("1714557600", "Asia/Tokyo", us(2024, 5, 1, 10)), ("1714557600500", None, us(2024, 5, 1, 10) + 500000),
    ("2024-10-27 02:30:00", "Europe/Berlin", us(2024, 10, 27, 0, 30)),  # repeated hour: first pass
    ("2024-03-31 02:30:00", "Europe/Berlin", us(2024, 3, 31, 1, 30)),  # skipped hour: offset before
    ("27 Oct 2024 02:30:00 CET", "Europe/Berlin", us(2024, 10, 27, 1, 30)), ("2024-122T10:00:00Z", None, us(2024, 5, 1, 10)), ("2024-W18-3T10:00:00Z", None, us(2024, 5, 1, 10)),
    ("Wed, 01 May 2024 10:00:00 GMT", None, us(2024, 5, 1, 10)), ("Wed May  1 10:00:00 UTC 2024", None, us(2024, 5, 1, 10)), ("May 1, 2024 12:05 AM", None, us(2024, 5, 1, 0, 5)),
    ("20240501T100000Z", None, us(2024, 5, 1, 10)), ("2024-05-01T12:00:00+02:00[Europe/Berlin]", None, us(2024, 5, 1, 10)), ("2024-05-01 12:00:00 Europe/Berlin", None, us(2024, 5, 1, 10)),
    ("２０２４-０５-０１T１０:００:００Z", None, us(2024, 5, 1, 10)), ("2024-05-01T10:00", "Nowhere/None", us(2024, 5, 1, 10)),
    ("2024-02-30T10:00:00Z", None, None), ("2024-06-30T23:59:60Z", None, None), ("2024-05-01T24:00:00Z", None, None), ("Mon, 01 May 2024 10:00:00 GMT", None, None),
    ("2024-13-01", None, None), ("0000-00-00 00:00:00", None, None), ("yesterday", None, None), ("", None, None), (None, None, None), ("9" * 100000, None, None), ("20230230101010", None, None),
])
def test_instants(text, zone, want):
    assert parse_instant(text, zone) == want


def test_swapped_days_and_civil_days():
    lo, hi = days_from_civil(2024, 4, 28), days_from_civil(2024, 5, 6)
    assert parse_instant("05/04/2024", None, lo, hi) == us(2024, 5, 4)
    assert parse_instant("04.05.2024", None, lo, hi) == us(2024, 5, 4)
    assert parse_instant("13/04/2024", None, lo, hi) == us(2024, 4, 13)
    for d in range(-200000, 200000, 997):
        x = dt.date(1970, 1, 1) + dt.timedelta(days=d)
        assert days_from_civil(x.year, x.month, x.day) == d


def test_instant_tables(spark):
    raw = spark.createDataFrame([(1, "p", "2024-05-01T10:00:00Z", 0), (2, "p", "2024-05-01T10:00:00", 0), (3, None, "2024-05-01T10:00:00", 0), (4, "p", None, 0), (2, "p", "2024-05-01T10:00:00", 0)], "raw_id long, package_id string, ts string, zone int")
    none = spark.createDataFrame([], "date_id long, package_id string, value string")
    packages = spark.createDataFrame([("p", "Europe/Berlin", T(0), T(1)), ("p", "Europe/Berlin", T(0), T(1)), (None, "Asia/Tokyo", T(0), T(1))], "package_id string, zone string, crawl_start timestamp_ntz, crawl_end timestamp_ntz")
    rows = date_texts({"raw_pages": raw, "manifest_dates": none})
    assert sorted((r["row_id"], r["epoch_us"]) for r in nonconforming_instants(rows, packages).collect()) == [(2, us(2024, 5, 1, 8))] * 2 + [(3, us(2024, 5, 1, 10))]
    assert normalise_instants(rows, packages.limit(0)).count() == 4


def test_heavy_keys_and_statistics(spark):
    rows = [("hot", f"d{i % 7}", f"{i:014d}") for i in range(5000)] + [(f"k{i}", None if i % 2 else "d", None) for i in range(200)] + [(None, "d", "1")] * 300
    df = spark.createDataFrame(rows, "key string, digest string, ts_raw string").withColumn("n", F.lit("clash")).repartition(7)
    assert [tuple(r) for r in heavy_keys({"t": df, "e": df.limit(0)}).collect()] == [("t", "hot", 5000)]
    got = {r["key"]: tuple(r)[1:] for r in key_statistics(df, ["key"]).collect()}
    assert got["hot"] == (5000, f"{0:014d}", f"{4999:014d}", 7) and got["k1"] == (1, None, None, 0) and got["k2"] == (1, None, None, 1) and got[None] == (300, "1", "1", 1)
    assert len(got) == 202


def test_global_order(spark):
    rng = random.Random(2)
    values = [(rng.randrange(50), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(values, "g long, i long, n long")
    want = {i: k for k, (_, i, _) in enumerate(sorted(values))}
    assert {r["i"]: r["ordinal"] for r in numbered(df, [F.col("g"), F.col("i")]).collect()} == want
    total, sums = 0, {}
    for _, i, n in sorted(values):
        sums[i] = total
        total += n
    assert {r["i"]: r["running_offset"] for r in running_offset(df, [F.col("g"), F.col("i")], "n").collect()} == sums
    before = {}
    prev = {}
    for g, i, n in sorted(values):
        before[i] = prev.get(g)
        prev[g] = n
    assert {r["i"]: r["previous"] and r["previous"]["n"] for r in with_previous(df, ["g"], ["i"], ["n"]).collect()} == before
    assert numbered(df.limit(0), [F.col("g")]).count() == 0


def test_block_candidates_against_scan_rule(spark):
    rng = random.Random(3)
    for _ in range(3):
        firsts = sorted(rng.choice("abcdef") for _ in range(6))
        blocks = spark.createDataFrame([("f", i, k) for i, k in enumerate(firsts)], "f string, block_no long, key string")
        keys = spark.createDataFrame([(k,) for k in "abcdefg"], "k string")
        got = {(r["block_no"], r["k"]) for r in index.candidate_blocks(blocks, keys, ["f"]).collect()}
        want = set()
        for k in "abcdefg":
            p = sum(x < k for x in firsts)
            for i in range(max(p - 1, 0), len(firsts)):
                if firsts[i] > k:
                    break
                want.add((i, k))
        assert got == want


def test_annotations_merge_like_a_fold(spark):
    rng = random.Random(4)
    rows = [(i, rng.randrange(5), rng.choice([None, "", "a", "b"]), rng.choice([None, True, False]), rng.choice([None, "", "u"])) for i in range(60)]
    want = {}
    for _, r, t, v, u in rows:
        a = want.setdefault(r, [None, False, None])
        a[0], a[1], a[2] = t or a[0], a[1] or bool(v), u if u is not None else a[2]
    got = pages.merge_annotations(spark.createDataFrame(rows, "ord long, record_id long, title string, via boolean, page_url string")).collect()
    assert {r["record_id"]: [r["title"], r["via"], r["page_url"]] for r in got} == want
    drafts = spark.createDataFrame([(1, 0, "x", "t", "d"), (2, 99, "y", "t", "d"), (3, 0, "x", "t", "d")], "ord long, record_id long, url string, ts_text string, title string")
    listed = pages.annotate(drafts, spark.createDataFrame([(0, None, True, "")], "record_id long, title string, via boolean, page_url string")).orderBy("ord").collect()
    assert [(r["url"], r["title"], r["via"]) for r in listed] == [("", "d", True), ("y", "d", False), ("", "d", True)]


@pytest.mark.parametrize(("url", "wayback", "warcio"), [
    ("https://www.example.com/page", "com,example)/page", "com,example)/page"), ("http://example.com/Dir/", "com,example)/dir", "com,example)/dir/"), ("https://example.com/?a={b}", "com,example)/?a={b}", "com,example)/?a={b}"),
    ("https://[2001:db8::1]:8080/Page", "2001:db8::1:8080)/page", "2001:db8::1:8080)/page"), ("http://example.com:80", "com,example)/", "com,example)/"), ("https://u@example.com:8443/x?b=2&a=1#f", "com,example:8443)/x?a=1&b=2", "com,example:8443)/x?a=1&b=2"),
    ("http://127.0.0.1/a?sid=" + "a" * 32, "127.0.0.1)/a", "127.0.0.1)/a"),
])
def test_url_keys(spark, url, wayback, warcio):
    r = spark.range(1).select(urls.surt_wayback(F.lit(url)), urls.surt_warcio(F.lit(url)), urls.lookup_keys(F.lit(url))).first()
    assert tuple(r)[:2] == (wayback, warcio) and list(r[2]) == list(dict.fromkeys((wayback, warcio)))


def test_digests_and_stamps(spark):
    import base64
    import hashlib

    h = hashlib.sha1(b"x")
    rows = [(h.hexdigest().upper(),), ("sha1:" + base64.b32encode(h.digest()).decode(),), ("SHA-1:" + h.hexdigest(),), (base64.b32encode(h.digest()).decode(),), ("sha256:zz",), (None,)]
    got = [r[0]["hex"] if r[0] else None for r in spark.createDataFrame(rows, "d string").select(stamps.digest_parts(F.col("d"))).collect()]
    assert got[1:4] == [h.hexdigest()] * 3 and got[4:] == [None, None]
    r = spark.range(1).select(stamps.synthetic_id(F.lit("2024-01-01T00:00:00Z"), F.lit("u"), 80), stamps.parse_cdx(F.lit("20240101000000123")), stamps.parse_cdx(F.lit("2024"))).first()
    assert len(r[0]) == 64 and r[1].microsecond == 123000 and r[2] is None


def test_layout_of_empty_listing(spark):
    none = spark.createDataFrame([], "package_id string, path string, compression string")
    assert checks.layout(none).count() == 0
    one = spark.createDataFrame([("p", "archive/x/y.warc", "deflated")], "package_id string, path string, compression string")
    assert {r["code"] for r in checks.layout(one).collect()} == {"LAYOUT_BAD_WARC_PATH", "LAYOUT_MISSING_MANIFEST", "LAYOUT_MISSING_PAGES", "LAYOUT_MISSING_WARC", "LAYOUT_MISSING_INDEX", "LAYOUT_NOT_STORED"}


def test_blocks_of_whole_index_lines(spark):
    from skeinlake.operators.index import capture_lines
    from skeinlake.plans.archive import QUERIES
    from skeinlake.session import table

    d = "/root/testdata/sf0.001"
    lines = sorted({r["line"].encode() for r in capture_lines(table(spark, d, "captures").where("key IS NOT NULL AND ts_raw IS NOT NULL")).collect()})
    assert {(r["line"].encode(), r["ordinal"], r["block_no"]) for r in QUERIES["index_line_blocks"](spark, d).collect()} == {(x, i, i // 1024) for i, x in enumerate(lines)}
    blocks = [lines[i : i + 1024] for i in range(0, len(lines), 1024)]
    sizes = [sum(len(x) + 1 for x in b) for b in blocks]
    want = {(i, b" ".join(b[0].split(b" ")[:2]).decode(), len(b), n) for i, (b, n) in enumerate(zip(blocks, sizes, strict=True))}
    assert {tuple(r) for r in QUERIES["index_line_summary"](spark, d).collect()} == want
    assert {tuple(r) for r in QUERIES["index_line_offsets"](spark, d).collect()} == {(i, n, sum(sizes[:i])) for i, n in enumerate(sizes)}
