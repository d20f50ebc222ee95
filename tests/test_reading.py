"""Captures by range, checks of damaged packages, strict readers and the writer's sinks."""

import base64
import hashlib
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F
from tests.test_packages import page, record, source

from skeinlake.functions.stamps import digest_parts
from skeinlake.operators.validate import captures_of, layer_report, package_lookup, parse_manifest, signature_fields, validate
from skeinlake.sinks.convert import Conversion
from skeinlake.sinks.package import PackageError, PackageWriter, WriterOptions
from skeinlake.sources import formats as W
from skeinlake.sources.captures import capture_bytes, single_record
from skeinlake.sources.readers import index_row, member_chunks, numbered_lines, register


def repack(src: str, dest: str, change) -> str:
    """A copy of a package with ``change(name, bytes)`` for each member."""
    with zipfile.ZipFile(src) as z, zipfile.ZipFile(dest, "w") as out:
        for e in z.infolist():
            data = change(e.filename, z.read(e))
            if data is not None:
                out.writestr(zipfile.ZipInfo(e.filename), data, e.compress_type)
    return dest


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("made")
    plain, blocks = str(folder / "plain.wacz"), str(folder / "blocks.wacz")
    Conversion(spark, source(folder / "in.warc"), plain).run()
    Conversion(spark, source(folder / "in2.warc", gzip=True), blocks, WriterOptions(zipnum_lines=1)).run()
    return plain, blocks


def test_only_the_ranges_found_are_read(spark, made):
    for path in made:
        got = captures_of(spark, path, "http://example.com/page").collect()
        assert sorted((r["http_status"], r["record_type"]) for r in got) == [(200, "response"), (304, "revisit")] and all(r["read_error"] is None for r in got)
        assert package_lookup(spark, path, "http://example.com/page", "2024-05-04", "2024-06-01").count() == 1
        line = got[0]
        raw = capture_bytes(line["package"], line["filename"], line["offset"], line["length"], line["record_digest"])
        assert len(raw) == line["length"] and single_record(raw)[1] == bytes(line["body"])
        for args, code in ((dict(record_digest="sha256:" + "0" * 64), "RECORD_DIGEST"), (dict(record_digest="x"), "RECORD_DIGEST_INVALID"), (dict(length=1 << 40), "RANGE"), (dict(offset=None), "MISSING_FIELD"), (dict(filename="none.warc"), "MISSING_MEMBER")):
            with pytest.raises(W.FormatError, match=code):
                capture_bytes(**{"package": line["package"], "filename": line["filename"], "offset": line["offset"], "length": line["length"], **args})
    one = record("response", 1, page("x"))
    with pytest.raises(W.FormatError, match="SEVERAL_RECORDS"):
        single_record(one + one)
    with pytest.raises(W.FormatError, match="NO_RECORD"):
        single_record(W.gzip_member(b""))
    assert single_record(W.gzip_member(one))[1] == page("x")


def test_damaged_packages_give_findings(spark, made, tmp_path):
    plain, blocks = made

    def change(name, data):
        return b"WARC/1.1\r\nbroken" + data if name.startswith("archive/") else data

    codes = {(r["layer"], r["code"]) for r in validate(spark, repack(plain, str(tmp_path / "a.wacz"), change)).collect()}
    assert any(x == "content" and c.startswith("CONTENT_") for x, c in codes) and any(x == "index" for x, c in codes)

    def flip(name, data):
        return bytes([data[0] ^ 255]) + data[1:] if name == "indexes/index.cdx.gz" else data

    rows = validate(spark, repack(blocks, str(tmp_path / "b.wacz"), flip)).collect()
    assert ("index", "INDEX_BLOCK_DIGEST", "indexes/index.idx:block 0") in {(r["layer"], r["code"], r["path"]) for r in rows}

    fields = {"url": "https://a.example/", "digest": None, "mime": "text/html", "status": 200}
    wrong = {"URL": {"url": "https://a.example/x"}, "STATUS": {"status": 404}, "MIME": {"mime": "image/png"}, "DIGEST": {"digest": "sha256:" + "A" * 43 + "="}, "MISSING_FIELD": {"filename": None}, "RANGE_OUT_OF_BOUNDS": {"offset": 1 << 30}, "RECORD_DIGEST": {"recordDigest": "sha256:" + "0" * 64}}
    data = page("One")
    warc = record("response", 1, data, WARC_Target_URI="https://a.example/")
    payload = data.partition(b"\r\n\r\n")[2]
    good = [{"digest": "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()}, {"digest": "sha-256:" + base64.b64encode(hashlib.sha256(payload).digest()).decode()}, {"digest": "md5:" + hashlib.md5(payload).hexdigest()}, {"status": None}]
    place = {"offset": 0, "length": len(warc), "filename": "a.warc"}
    keys = [*wrong, *(f"good{k}" for k in range(len(good))), "KEY", "TIMESTAMP"]
    lines = []
    for k, change in zip(keys, [*wrong.values(), *good, {}, {}], strict=True):
        row = {x: y for x, y in {**fields, **place, **change}.items() if y is not None}
        lines.append(f"{'com,b)/' if k == 'KEY' else 'example,a)/'} {'20240502100001' if k == 'TIMESTAMP' else '20240502100000'} {json.dumps(row)}\n")
    with zipfile.ZipFile(tmp_path / "c.wacz", "w") as z:
        z.writestr("archive/a.warc", warc)
        z.writestr("indexes/index.cdx", "".join(lines))
    got = {r["path"].rpartition(":")[2]: r["code"] for r in validate(spark, str(tmp_path / "c.wacz"), ("index",)).where("layer = 'index'").collect()}
    assert got == {str(n): "INDEX_" + k for n, k in enumerate(keys, 1) if not k.startswith("good")}
    report = {r["layer"]: r["findings"] for r in layer_report(validate(spark, str(tmp_path / "c.wacz"), ("index",)), ("index",)).collect()}
    assert report["index"] == len(got) and report["content"] >= 0 and report["layout"] is None and report["fixity"] is None


def test_strict_readers(spark, tmp_path):
    register(spark)
    pages = ['{"format": "json-pages-1.0"}', '{"url": "http://a/", "ts": "2024-01-01T00:00:00Z"}', "", '{"url": "http://a/", "ts": "2024-01-01 00:00"}']
    line = "com,a)/ 20240101000000 {}"
    with zipfile.ZipFile(tmp_path / "a.wacz", "w") as z:
        z.writestr("pages/pages.jsonl", "\n".join(pages) + "\n")
        z.writestr("indexes/index.cdx", f"{line}\n\nbad\n{line}\n")
    read = lambda f, **o: spark.read.format(f).options(**o).load(str(tmp_path / "a.wacz"))
    assert [(r["line_no"], r["malformed"]) for r in read("pagelist").collect()] == [(1, False), (2, False), (4, False)]
    assert [(r["line_no"], r["malformed"]) for r in read("pagelist", strict="true").collect()] == [(1, False), (2, False), (3, True), (4, True)]
    assert [(r["line_no"], r["error"]) for r in read("cdxj").collect()] == [(1, None), (3, "INDEX_LINE"), (4, None)]
    assert [(r["line_no"], r["error"]) for r in read("cdxj", strict="true").collect()] == [(1, None), (2, "BLANK_LINE"), (3, "INDEX_LINE"), (4, None)]
    codes = {r["code"] for r in validate(spark, str(tmp_path / "a.wacz"), ("content",)).collect()}
    assert codes == {"CONTENT_PAGE_LINE:3", "CONTENT_INDEX_LINE:1"}
    assert index_row("p", "i", 1, "bad")[-1] == "INDEX_LINE"


def test_lines_of_blocks_are_numbered_in_their_index(spark, made):
    register(spark)
    lines = numbered_lines(spark.read.format("cdxj").load(made[1]))
    assert sorted(r["line_no"] for r in lines.collect()) == [1, 2, 3]
    assert lines.where(F.col("block").isNull()).count() == 0


def test_member_views(tmp_path):
    with zipfile.ZipFile(tmp_path / "x.wacz", "w") as z:
        z.writestr("a.txt", b"abc" * 1000, zipfile.ZIP_DEFLATED)
        z.writestr("b.gz", W.gzip_member(b"one") + W.gzip_member(b"two"))
    with zipfile.ZipFile(tmp_path / "x.wacz") as z:
        join = lambda n, v: b"".join(member_chunks(z, n, v))
        assert join("a.txt", "raw") == b"abc" * 1000 and len(join("a.txt", "stored")) == z.getinfo("a.txt").compress_size < 100
        assert join("b.gz", "decoded") == b"onetwo" and join("b.gz", "raw") == join("b.gz", "stored") and join("a.txt", "decoded") == b"abc" * 1000


def test_digests_in_every_encoding(spark):
    d = {a: hashlib.new(a, b"x").digest() for a in W.ALGORITHMS}
    rows = [(a, f"{a.upper()}:{e(v)}") for a, v in d.items() for e in (bytes.hex, lambda v: base64.b32encode(v).decode(), lambda v: base64.b32encode(v).decode().rstrip("=").lower(), lambda v: base64.b64encode(v).decode(), lambda v: base64.urlsafe_b64encode(v).decode().rstrip("="))]
    rows += [("sha1", base64.b32encode(d["sha1"]).decode())]
    got = spark.createDataFrame(rows, "a string, d string").select("a", "d", digest_parts(F.col("d")).alias("p")).collect()
    assert all((r["p"]["algorithm"], r["p"]["hex"]) == (r["a"], d[r["a"]].hex()) for r in got)
    assert all(W.parse_digest(t) == (a, d[a]) for a, t in rows)
    for bad in ("sha256:", "sha256:abc", "crc:00", "sha1:" + "!" * 32, ""):
        assert W.parse_digest(bad) is None
        assert spark.createDataFrame([(bad,)], "d string").select(digest_parts(F.col("d"))["hex"]).first()[0] is None


def test_writer_in_memory_and_its_sinks(tmp_path):
    out = io.BytesIO()
    warc = [record("response", n, page(str(n)), WARC_Target_URI=f"https://a.example/{n}") for n in (1, 2)]
    line = 'example,a)/ 20240502100000 {"url": "https://a.example/", "digest": "sha1:x", "mime": "text/html", "status": 200, "offset": 0, "length": 9, "filename": "a.warc.gz"}\n'
    with PackageWriter(out) as w:
        placed = w.write_records("a.warc.gz", warc)
        for bad in ("archive/x", "indexes/x", "pages/x"):
            with pytest.raises(PackageError, match="RESERVED_PREFIX"):
                w.add_resource(bad, [b""])
        with pytest.raises(PackageError, match="NAME"):
            w.add_resource("data/Upper.txt", [b""])
        w.add_resource("data/mine.txt", [b"x"])
        for bad in ("x/y.cdx", "a.txt"):
            with pytest.raises(PackageError, match="INDEX_NAME"):
                w.add_sorted_index_file(bad, io.BytesIO(line.encode()))
        for text, code in ((line.replace("2024", "2025", 1) + line, "INDEX_ORDER"), (line + "\n", "INDEX_LINE")):
            with pytest.raises(PackageError, match=code):
                w.add_sorted_index_file("index.cdx", io.BytesIO(text.encode()))
        w.add_sorted_index_file("index.cdx", io.BytesIO((line * 2).encode()))
        head = b'{"format": "json-pages-1.0"}\n'
        for text in (b"", head + b"\n", head + b'{"url": "u", "ts": "2024"}\n', b"{}\n"):
            with pytest.raises(PackageError, match="PAGE_LINE"):
                w.add_page_list_file("pages/pages.jsonl", io.BytesIO(text))
        stream = io.BytesIO(b"skip" + head + b'{"url": "u", "ts": "2024-01-01T00:00:00Z"}\n')
        stream.seek(4)
        w.add_page_list_file("pages/pages.jsonl", stream)
        w.finish()
    with zipfile.ZipFile(out) as z:
        stored = z.read("archive/a.warc.gz")
        assert [W.gunzip(stored[o : o + n]) for o, n, _ in placed] == warc and all(W.digest_matches(d, stored[o : o + n]) for o, n, d in placed)
        assert z.read("indexes/index.cdx").decode() == line * 2
    (tmp_path / "own.warc").write_bytes(warc[0])
    with PackageWriter(str(tmp_path / "b.wacz")) as w:
        w.add_warc(str(tmp_path / "own.warc"))
        with pytest.raises(PackageError, match="WARC_NAME"):
            w.add_warc([b""], "x.txt")
        with pytest.raises(PackageError, match="MISSING_INDEX"):
            w.finish()


def test_manifest_repairs_and_signatures():
    m, repairs = parse_manifest(b'{"created": "2024-01-01T10:00:00", "modified": "x", "mainPageDate": "2024-02-01", "title": "T"}')
    assert m == {"created": "2024-01-01T10:00:00Z", "modified": "x", "mainPageDate": "2024-02-01T00:00:00Z", "title": "T"}
    assert [(k, to) for k, _, to in repairs] == [("created", "2024-01-01T10:00:00Z"), ("modified", None), ("mainPageDate", "2024-02-01T00:00:00Z")]
    with pytest.raises(W.FormatError):
        parse_manifest(b"[]")
    signed = {"hash": "h", "created": "c", "software": "s", "version": "v", "signature": "g", "domain": "d"}
    assert signature_fields(json.dumps({"signedData": signed}).encode()) == {"kind": "domain", "hash": "h", "created": "c", "software": "s", "version": "v", "signature": "g"}
    assert signature_fields(b"{}")["kind"] is None
