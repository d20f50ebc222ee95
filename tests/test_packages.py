"""Containers end to end: convert, read, check, corrupt."""

import json
import zipfile

import pytest

from skeinlake.operators.validate import captures_of, manifest_problems, resource_bytes, signature_state, validate
from skeinlake.sinks.convert import Conversion
from skeinlake.sinks.manifest import Contributor, License, Metadata, Source
from skeinlake.sinks.package import PackageError, PackageWriter, WriterOptions
from skeinlake.sources import formats as W
from skeinlake.sources.readers import member_range, register


def record(kind: str, n: int, body: bytes, **more: str) -> bytes:
    head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{n}>", "WARC-Date": more.pop("date", f"2024-05-{n + 1:02d}T10:00:00Z"), **{k.replace("_", "-"): v for k, v in more.items()}, "Content-Length": str(len(body))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def page(title: str, status: int = 200, kind: str = "text/html; charset=utf-8") -> bytes:
    return f"HTTP/1.1 {status} OK\r\nContent-Type: {kind}\r\n\r\n<html><title>{title}</title></html>".encode()


def source(path, gzip: bool = False) -> str:
    records = [
        record("warcinfo", 0, b"title: A crawl\r\ndescription: small\r\n"),
        record("metadata", 1, b"title: Noted\r\n", WARC_Refers_To="<urn:uuid:2>"),
        record("response", 2, page("One"), WARC_Target_URI="https://www.example.com/page/"),
        record("response", 3, page("Two"), WARC_Target_URI="https://example.com/other?b=2&a=1"),
        record("metadata", 4, b"via: https://example.com/\r\n", WARC_Concurrent_To="<urn:uuid:3>"),
        record("response", 5, b"no http here", WARC_Target_URI="https://example.com/bad"),
        record("response", 6, page("Dns"), WARC_Target_URI="dns:example.com"),
        record("revisit", 7, page("One", 304), WARC_Target_URI="https://www.example.com/page/", WARC_Payload_Digest="sha256:" + "0" * 64),
        record("warcinfo", 8, b"title: Second\r\n"),
    ]
    data = b"".join(W.gzip_member(r) for r in records) if gzip else b"".join(records)
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("lines", [None, 1])
def test_convert_read_and_validate(spark, tmp_path, lines):
    dest = str(tmp_path / "out.wacz")
    done = Conversion(spark, source(tmp_path / "in.warc", gzip=lines is not None), dest, WriterOptions(zipnum_lines=lines)).run()
    assert (done.records, done.captures, done.pages, done.extra_pages) == (9, 3, 3, 1)
    assert [c for c, _ in done.warnings] == ["MULTIPLE_WARCINFO", "HTTP_UNPARSEABLE"]
    with zipfile.ZipFile(dest) as z:
        manifest = json.loads(z.read("datapackage.json"))
        assert manifest["title"] == "A crawl" and manifest["mainPageUrl"] == "https://www.example.com/page/"
        listed = [json.loads(x) for x in z.read("pages/pages.jsonl").decode().splitlines()]
        assert listed[0]["format"] == "json-pages-1.0" and [p.get("title") for p in listed[1:]] == ["Noted", None]
        assert len(listed[1]["id"]) == 24
    found = validate(spark, dest).collect()
    assert found == []
    hits = captures_of(spark, dest, "http://example.com/page").select("status", "record_type").collect()
    assert sorted(map(tuple, hits)) == [(200, "response"), (304, "revisit")]
    assert resource_bytes(spark, dest, "pages/pages.jsonl").count() == 1 and resource_bytes(spark, dest, "none").count() == 0
    register(spark)
    assert spark.read.format("warc").load(dest).where("record_type = 'metadata'").count() == 2
    assert spark.read.format("pagelist").load(dest).where("not is_header").count() == 3


def test_corruption_is_found(spark, tmp_path):
    dest = str(tmp_path / "out.wacz")
    Conversion(spark, source(tmp_path / "in.warc"), dest).run()
    bad = str(tmp_path / "bad.wacz")
    with zipfile.ZipFile(dest) as z, zipfile.ZipFile(bad, "w", zipfile.ZIP_DEFLATED) as out:
        for n in z.namelist():
            data = z.read(n)
            if n == "indexes/index.cdx":
                data = data.replace(b'"status":200', b'"status":201', 1)
            if n == "pages/pages.jsonl":
                data += b"\n{}\n"
            out.writestr(n, data)
        out.writestr("extra.txt", "x")
    codes = {(r["layer"], r["code"]) for r in validate(spark, bad).collect()}
    assert ("layout", "LAYOUT_NOT_STORED") in codes and ("manifest", "MANIFEST_UNLISTED_MEMBER") in codes
    assert ("fixity", "FIXITY_MISMATCH") in codes and ("index", "INDEX_STATUS") in codes
    assert any(layer == "content" and code.startswith("CONTENT_PAGE_LINE") for layer, code in codes)
    assert {r["layer"] for r in validate(spark, bad, ("layout",)).collect()} == {"layout"}


def test_writer_rules(tmp_path):
    with pytest.raises(PackageError):
        PackageWriter(str(tmp_path / "a.zip"))
    with pytest.raises(PackageError):
        WriterOptions(gzip_level=10)
    with PackageWriter(str(tmp_path / "a.wacz")) as w:
        w.add("archive/a.warc", [b"x"])
        for path in ("../x", "datapackage.json", "archive/a.warc", "a//b"):
            with pytest.raises(PackageError):
                w.add(path, [b"y"])
        with pytest.raises(PackageError, match="MISSING_INDEX"):
            w.finish()
    assert not list(tmp_path.iterdir())
    (tmp_path / "b.wacz").write_bytes(b"")
    with pytest.raises(PackageError, match="EXISTS"):
        PackageWriter(str(tmp_path / "b.wacz"))


def test_formats():
    assert W.gunzip(W.gzip_member(b"a") + W.gzip_member(b"b")) == b"ab"
    assert [W.gzip_member(b"", n)[8] for n in (0, 1, 6, 9)] == [4, 4, 0, 2]
    with pytest.raises(W.FormatError, match="DECOMPRESSION_LIMIT"):
        W.gunzip(W.gzip_member(b"a" * 100), 99)
    assert W.dechunk(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and W.dechunk(b"plain") == b"plain" and W.dechunk(b"3\r\nabc\r\n") == b"abc"
    status, headers, payload = W.http_response(b"HTTP/1.1 200 OK\r\nX: a\r\n  b\r\nTransfer-Encoding: chunked\r\n\r\n2\r\nhi\r\n0\r\n\r\n")
    assert (status, headers["x"], payload) == (200, ["a b"], b"hi")
    assert W.http_response(b"nothing") is None
    assert W.parse_index_line('com,example)/?a={b} 20240101000000 {"url": 1}') == ("com,example)/?a={b}", "20240101000000", {"url": 1})
    with pytest.raises(W.FormatError, match="SUMMARY_ORDER"):
        W.parse_summary('!meta 0 {"format": "cdxj-gzip-1.0", "filename": "x"}\n' + "".join(f'{k} 20240101000000 {{"offset": 0, "length": 1, "digest": "d"}}\n' for k in "ba"))


def test_signature_states():
    manifest = b"{}"
    import hashlib

    good = "sha256:" + hashlib.sha256(manifest).hexdigest()
    base = {"path": "datapackage.json", "hash": good}
    signed = {"hash": good, "created": "x", "software": "y", "signature": "z"}
    assert signature_state(None, manifest)[0] == "absent"
    assert signature_state(json.dumps(base).encode(), manifest)[0] == "unsigned"
    assert signature_state(json.dumps(base | {"signedData": signed | {"publicKey": "k"}}).encode(), manifest)[0] == "unverified"
    assert signature_state(json.dumps(base | {"signedData": signed | {"publicKey": "k", "domain": "d"}}).encode(), manifest) == ("invalid", ["SIGNATURE_VARIANT"])
    assert signature_state(json.dumps(base | {"hash": "sha256:0"}).encode(), manifest) == ("invalid", ["SIGNATURE_MANIFEST_HASH"])
    assert signature_state(b"[", manifest) == ("invalid", ["SIGNATURE_UNPARSEABLE"])


def test_member_range(tmp_path):
    p = tmp_path / "x.wacz"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("archive/a", b"0123456789")
        z.writestr(zipfile.ZipInfo("b"), b"0123", zipfile.ZIP_DEFLATED)
    assert member_range(str(p), "archive/a", 2, 3) == b"234"
    for args, code in ((("archive/a", 8, 3), "RANGE"), (("b", 0, 1), "COMPRESSED")):
        with pytest.raises(W.FormatError, match=code):
            member_range(str(p), *args)


def test_metadata_builders():
    from datetime import UTC, datetime

    m = Metadata(name="a-b", title="T", sources=[Source("s")], licenses=[License(name="CC0")], contributors=[Contributor("c", role="author")], created=datetime(2024, 1, 1, 0, 0, 0, 120000, UTC), extra={"mine": 1}).row()
    assert m["created"] == "2024-01-01T00:00:00.12Z" and m["mine"] == 1 and "keywords" not in m
    raw = json.dumps({"profile": "data-package", "wacz_version": "1.1.1", "resources": [{"name": "x", "path": "y"}], **m}).encode()
    assert manifest_problems(raw)[0] == []
    for bad in (Metadata(name="A B"), Metadata(extra={"title": "x"}), Metadata(sources=[Source("")]), Metadata(licenses=[License()]), Metadata(contributors=[Contributor("c", role="Author")]), Metadata(created=datetime(2024, 1, 1))):
        with pytest.raises(PackageError):
            bad.row()
    codes = [c for c, _ in manifest_problems(b'{"created": "2024-01-01T00:00:00", "modified": "x", "sources": [{}], "licenses": [{}], "contributors": [{"title": "t", "role": "X"}], "name": "A"}')[0]]
    assert codes == ["MANIFEST_DATE_NONCONFORMING", "MANIFEST_DATE_INVALID", "MANIFEST_PROFILE", "MANIFEST_VERSION", "MANIFEST_NAME", "MANIFEST_NO_RESOURCES", "MANIFEST_SOURCE", "MANIFEST_LICENSE", "MANIFEST_ROLE"]
    assert manifest_problems(b"[")[0] == [("MANIFEST_UNPARSEABLE", "datapackage.json")]
