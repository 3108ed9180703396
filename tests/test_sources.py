"""Feeds from text: XML, JSON, codecs, catalog, exports."""

import bz2
import gzip
import io
import json
import tarfile
import threading
import zipfile
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from siftline.sources import objects, sinks, sniff
from siftline.sources.catalog import Catalog, Entry
from siftline.sources.markup import records
from siftline.sources.reader import FeedError, read_feed

JOBS = """
<?xml version="1.0"?><source><lastBuildDate>x</lastBuildDate><publisher>p</publisher>
<job><id>1</id><title>Cook</title><company>A</company><location><city>Rome</city><country>IT</country></location></job>
<job><id>2</id><title>Clerk</title><company>B</company></job></source>"""


def one(body, tag="job", skip=False):
    return next(records(body, tag, skip))


def test_tag_and_paths():
    assert sniff.detect_record_tag(JOBS) == "job"
    a, b = records(JOBS, "job")
    assert sorted(a) == ["company", "id", "location.city", "location.country", "title"] and "location.city" not in b
    odd = '<vacancies><vacancy id="7" date="d"><Position><JobTitle>T</JobTitle></Position></vacancy><vacancy id="8"><Position/></vacancy></vacancies>'
    assert sniff.detect_record_tag(odd) == "vacancy"
    assert [*records(odd, "vacancy")] == [{"id": "7", "date": "d", "Position.JobTitle": "T"}, {"id": "8"}]


def test_html_in_description():
    body = "<jobfeed><jobs><job><refcode><![CDATA[R1]]></refcode><description><ul><li>one<li>two</ul><h2>Head</h2><p>para<br>line</description></job><job><refcode>R2</refcode></job></jobs></jobfeed>"
    assert sniff.detect_record_tag(body) == "job"
    a, b = records(body, "job")
    assert a["refcode"] == "R1" and "description.ul.li" not in a and b == {"refcode": "R2"}
    assert a["description"].split("\n") == ["• one", "• two", "Head", "para", "line"]
    assert one(body, skip=True) == {"refcode": "R1"}


def test_pairs():
    body = "<job><cf><customfield><name>City</name><value>Rome</value></customfield><customfield><name>City</name><value>Bari</value></customfield></cf><field name=\"city\">London</field></job>"
    assert one(body) == {"cf.City": "Rome, Bari", "field": "London", "city": ""}


def test_text_rules():
    assert one('<job a="x&amp;y"><t>a&amp;b</t><u>a&nbsp;b</u><v>1</v><v>2</v><w>lead<x>in</x></w></job>') == {"a": "x&amp;y", "t": "a&b", "v": "1, 2", "w.x": "in"}
    assert [*records('<ns:job id="1"/><ns:job><ns:t>x</ns:t></ns:job>', "job")] == [{"id": "1"}, {"t": "x"}]
    assert one("<job><t>a</t><job><t>b</t></job></job>") == {"t": "a", "job.t": "b"}
    assert one("<job><t>a<u>b</t></job>") == {"t": "a b"}  # u is formatting, and need not be closed
    assert one("<job><t>a<x>b</t><y>c</y></job>") == {"t": "b", "y": "c"}


def test_flatten():
    v = objects.load('{"a":1.0,"b":1e5,"c":[1,"a",null],"d":["x","y"],"e":[{"f":1},{"f":true}],"g":[],"h":null,"i":{"j":false},"description":"d","k":{"body":1}}')
    flat = objects.flatten(v)
    assert flat == {"a": "1.0", "b": "1e5", "c": '[1,"a",null]', "d": "x, y", "e.0.f": "1", "e.1.f": "true", "i.j": "false", "description": "d", "k.body": "1"}
    assert "description" not in objects.flatten(v, True) and "k.body" not in objects.flatten(v, True)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_objects_in_pieces(size):
    text = ' {"a":"}\\"{"}, {"b":{"c":[1,2]}} , 3, {"d":"\\\\"} ] {"no":1}'
    parts = [text[i : i + size] for i in range(0, len(text), size)]
    assert [*objects.objects(parts, True)] == ['{"a":"}\\"{"}', '{"b":{"c":[1,2]}}', '{"d":"\\\\"}']


def test_sniffing():
    assert sniff.sniff_format(b"\xef\xbb\xbf  <a>", "x.json") == "xml" and sniff.sniff_format(b"zzz", "a.ndjson") == "json" and sniff.sniff_format(b"", "a") == "xml"
    assert [sniff.codec_of(n) for n in ("a.tar.gz", "a.TGZ", "a.gz", "a.bz2", "a.zip", "a.xml")] == ["tar", "tar", "gzip", "bzip2", "zip", None]


def values(feed, *names):
    return sorted(tuple(r) for r in feed.df.select(*names).collect())


def test_read_xml(spark, tmp_path):
    p = tmp_path / "jobs.xml"
    p.write_text(JOBS)
    feed = read_feed(spark, str(p))
    assert feed.columns == ["company", "id", "location_city", "location_country", "title"] and feed.names.original("location_city") == "location.city"
    assert values(feed, "id", "location_city") == [("1", "Rome"), ("2", None)]
    assert values(read_feed(spark, str(p), split=False), "id") == [("1",), ("2",)]


@pytest.mark.parametrize("kind", ["gz", "bz2", "zip", "tar.gz"])
def test_codecs(spark, tmp_path, kind):
    p = tmp_path / f"jobs.xml.{kind}"
    if kind == "gz":
        p.write_bytes(gzip.compress(JOBS[:200].encode()) + gzip.compress(JOBS[200:].encode()))
    elif kind == "bz2":
        p.write_bytes(bz2.compress(JOBS.encode()))
    elif kind == "zip":
        with zipfile.ZipFile(p, "w") as z:
            z.writestr("small.xml", "<a/>")
            z.writestr("jobs.xml", JOBS)
    else:
        with tarfile.open(p, "w:gz") as t:
            for name, text in (("readme.txt", "x" * 9), ("jobs.xml", JOBS)):
                info = tarfile.TarInfo(name)
                info.size = len(text.encode())
                t.addfile(info, io.BytesIO(text.encode()))
    assert values(read_feed(spark, str(p)), "id", "title") == [("1", "Cook"), ("2", "Clerk")]


def test_read_json(spark, tmp_path):
    lines = tmp_path / "a.ndjson"
    lines.write_text('{"id":1,"company":{"name":"X","city":"Paris"},"tags":["a","b"]}\nbroken{\n{"id":2,"tags":[]}\n')
    feed = read_feed(spark, str(lines))
    assert values(feed, "id", "company_city", "tags") == [("1", "Paris", "a, b"), ("2", None, None)]
    array = tmp_path / "b.json"
    array.write_text('[\n {"job":{"title":"T","salary":180000,"locations":["Berlin","London"]}},\n {"job":{"title":"U"}}\n]')
    assert values(read_feed(spark, str(array)), "job_title", "job_salary", "job_locations") == [("T", "180000", "Berlin, London"), ("U", None, None)]
    assert values(read_feed(spark, str(array), record_tag="job"), "title") == [("T",), ("U",)]
    wrapped = tmp_path / "c.json"
    wrapped.write_text(json.dumps({"status": "ok", "data": [{"id": 1, "location": {"city": "A"}}, {"id": 2, "location": {"city": "B"}}], "total": 2}, indent=1))
    assert values(read_feed(spark, str(wrapped)), "id", "location_city") == [("1", "A"), ("2", "B")]


def test_late_columns_and_empty(spark, tmp_path):
    p = tmp_path / "late.ndjson"
    p.write_text("\n".join(json.dumps({"a": i} | ({"z.late": 1} if i == 20_000 else {})) for i in range(20_001)))
    feed = read_feed(spark, str(p))
    assert feed.columns == ["a", "z_late"] and feed.populated("z_late").df.count() == 1
    empty = tmp_path / "none.ndjson"
    empty.write_text("{}\n")
    assert read_feed(spark, str(empty)).columns == ["id"]


@pytest.fixture
def server():
    """Feeds by name, gzipped or not; anything else is not found."""
    found = {"/jobs.xml": JOBS.encode(), "/jobs.xml.gz": gzip.compress(JOBS.encode()), "/a%20b/jobs": gzip.compress(JOBS.encode())}

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            if self.path == "/moved":
                self.send_response(302)
                self.send_header("Location", "jobs.xml")
                self.end_headers()
                return
            body = found.get(self.path.split("?")[0])
            self.send_response(200 if body else 403 if "secret" in self.path else 404)
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_address[1]}"
    s.shutdown()


@pytest.mark.parametrize("name", ["jobs.xml", "jobs.xml.gz?x=1", "a%20b/jobs", "moved"])
def test_http(spark, server, name):
    assert values(read_feed(spark, f"{server}/{name}"), "id", "title") == [("1", "Cook"), ("2", "Clerk")]


def test_http_error(spark, server):
    with pytest.raises(FeedError, match="HTTP 404: the feed was not found"):
        read_feed(spark, f"{server}/none.xml")
    with pytest.raises(FeedError, match="HTTP 403"):
        read_feed(spark, f"{server}/secret.xml")
    with pytest.raises(FeedError, match="could not be reached"):
        read_feed(spark, "http://127.0.0.1:9/x.xml")


def test_one_line_array(spark, tmp_path):
    """Records of an array on one line, nested, with braces in strings, over many pieces."""
    rows = [{"id": i, "note": "} ] {" if i % 3 else "\\\"}", "at": {"city": f"c{i}", "tags": ["x", "y"]}} for i in range(5000)]
    p = tmp_path / "one.json"
    p.write_text("\ufeff" + json.dumps({"meta": {"n": 1}, "jobs": rows, "after": [{"id": "no"}]}))
    feed = read_feed(spark, str(p))
    got = feed.df.collect()
    assert len(got) == 5000 and {(r["id"], r["note"], r["at_city"], r["at_tags"]) for r in got} == {(str(r["id"]), r["note"], r["at"]["city"], "x, y") for r in rows}
    assert feed.kept.is_cached and (feed.release() or not feed.kept.is_cached)
    plain = tmp_path / "plain.json"
    plain.write_text(json.dumps([{"a": 1}, {"b": [{"c": 2}]}], separators=(",", ":")))
    assert read_feed(spark, str(plain)).columns == ["a", "b_0_c"]


def test_tag_beyond_the_beginning(spark, tmp_path):
    """A feed whose records begin behind what is looked at first."""
    p = tmp_path / "late.xml"
    p.write_text("<source><!--" + "x" * (600 << 10) + "--><posting><t>a</t></posting><posting><t>b</t></posting></source>")
    assert values(read_feed(spark, str(p)), "t") == [("a",), ("b",)]
    assert sniff.detect_record_tag("<a>") is None


def test_too_many_keys(spark, tmp_path):
    p = tmp_path / "keys.ndjson"
    p.write_text("\n".join(json.dumps({f"k{i}": 1}) for i in range(50)))
    with pytest.raises(FeedError, match="more than 40 different keys"):
        read_feed(spark, str(p), max_columns=40)


def test_catalog_and_exports(spark, tmp_path):
    p = tmp_path / "jobs.xml"
    p.write_text(JOBS)
    feed = read_feed(spark, str(p))
    catalog = Catalog(str(tmp_path / "catalog"))
    catalog.save(feed, "f1", "jobs.xml")
    again = catalog.load(spark, "f1")
    assert again.names.original("location_city") == "location.city" and again.df.count() == 2
    for k in range(31):
        catalog.add(Entry(f"x{k}", "n", "file", "", 1, 1, f"/none/{k}"))
    assert len(catalog.entries()) == 30 and catalog.entries()[0].id == "x30"
    catalog.delete("x30")
    assert catalog.entries()[0].id == "x29"
    assert sinks.export_records(feed, str(tmp_path / "csv"), text="city:Rome") == 1
    assert sinks.export_records(feed, str(tmp_path / "rows.json"), as_json=True) == 2
    assert {r["id"] for r in json.loads((tmp_path / "rows.json").read_text())} == {"1", "2"}
    assert sinks.export_frequency(feed, "location.city", str(tmp_path / "freq")) == 1
    assert sinks.export_pairs(feed, "company", "title", str(tmp_path / "pairs")) == 2
    assert sinks.export_cross_tab(feed, "company", "title", str(tmp_path / "cross")) == 2
    assert sinks.export_custom(feed, ["company"], str(tmp_path / "custom"), deduplicate=True) == 2
    assert sinks.export_companies(feed, str(tmp_path / "companies")) == 2
    assert sinks.export_profile(feed.profile(), str(tmp_path / "profile")) == 5
    text = spark.read.option("header", True).csv(str(tmp_path / "profile"))
    assert text.columns[0] == "Column Name" and len(text.columns) == 10
