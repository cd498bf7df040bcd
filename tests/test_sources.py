import io
import zipfile

import pytest

from docloom.sources.captions import caption_lines, paragraphs
from docloom.sources.files import candidate_files, parse_file, parse_files, parse_source_list, scan_changes
from docloom.sources.formats import Archive, UnsafeArchive, decode_text, detect_format
from docloom.sources.payloads import extend_feed, feed_entries, items, parse_feed, repositories, sitemap_urls, web_results, works


def packed(**members: str | bytes) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name.replace("__", "/"), data)
    return out.getvalue()


def raw_zip(members: dict) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = raw_zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Rules</w:t></w:r></w:p><w:p><w:r><w:t>Buy </w:t></w:r><w:r><w:t>low</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
XLSX = raw_zip({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="One" sheetId="1" r:id="rId1"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId1" Type="t/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>name</t></si></sst>", "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>',
})
PPTX = raw_zip({"ppt/presentation.xml": "<p/>", "ppt/slides/slide1.xml": '<p:sld xmlns:p="p" xmlns:a="a"><p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Title</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>Body</a:t></a:r></a:p></p:txBody></p:sp><c:chart xmlns:c="c"/></p:sld>'})
EPUB = raw_zip({"mimetype": "application/epub+zip", "META-INF/container.xml": '<container xmlns="c"><rootfiles><rootfile full-path="o/b.opf"/></rootfiles></container>', "o/b.opf": '<package xmlns:dc="d"><metadata><dc:title>Book</dc:title><dc:creator>A</dc:creator></metadata><manifest><item id="c" href="c.xhtml"/></manifest><spine><itemref idref="c"/></spine></package>', "o/c.xhtml": "<html><body><h1>One</h1><p>Text</p></body></html>"})


def texts(data, name):
    return [b["text"] for b in parse_file(name, data)["blocks"]]


def test_packages():
    assert [detect_format("x", d) for d in (DOCX, XLSX, PPTX, EPUB)] == ["docx", "xlsx", "pptx", "epub"]
    doc = parse_file("x", DOCX)
    assert [(b["text"], b["section"]) for b in doc["blocks"]] == [("Rules", "Rules"), ("Buy low", "Rules")] and doc["tables"] == [[["a", "b"]]]
    assert texts(XLSX, "x") == ["name |  | 2"]
    deck = parse_file("x", PPTX)
    assert [(b["text"], b["slide"], b["section"]) for b in deck["blocks"]] == [("Title", 1, "Title"), ("Body", 1, "Title")] and deck["limitations"] == ["UNREADABLE_CHART_DATA: slide 1"]
    book = parse_file("x", EPUB)
    assert book["metadata"] == {"title": "Book", "author": "A"} and [(b["text"], b["item"]) for b in book["blocks"]] == [("One", "c.xhtml"), ("Text", "c.xhtml")]
    locked = raw_zip({"mimetype": "", "META-INF/container.xml": "<c/>", "META-INF/encryption.xml": "<e/>"})
    assert parse_file("x", locked)["access_status"] == "ACCESS_RESTRICTED"


def test_archives():
    both = parse_file("a.zip", raw_zip({"r.txt": "see https://x.example/p doi 10.1234/ab.", "s.bin": b"\0", "t/u.docx": DOCX}))
    assert [b["item"] for b in both["blocks"]] == ["r.txt", "t/u.docx", "t/u.docx"] and both["refs"] == ["doi:10.1234/ab"] and "SKIPPED_MEMBER: s.bin (unknown)" in both["limitations"]
    for bad in (raw_zip({"../x": "a"}), raw_zip({"/x": "a"}), raw_zip({"bomb": b"0" * 5_000_000}), b"PK\x03\x04broken"):
        with pytest.raises(UnsafeArchive):
            Archive(bad)
        assert parse_file("a.zip", bad)["access_status"] == "ERROR"
    entity = raw_zip({"word/document.xml": '<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>'})
    assert parse_file("x", entity)["limitations"][0].startswith("PARSE_ERROR")


def test_html_markdown_text():
    page = b'<html><head><title>T</title><meta name="citation_title" content="Best"><meta property="og:title" content="x"></head><body><nav>menu</nav><main><h2>Head</h2>loose <b>text<p>One<p>two<script>var a="</p>"</script><a href="/l">l</a></main><footer>f</footer></body></html>'
    got = parse_file("https://s.example/a", page, "text/html; charset=utf-8")
    assert got["metadata"]["title"] == "Best" and got["links"] == ["https://s.example/l"]
    assert [(b["text"], b["section"]) for b in got["blocks"]] == [("Head", "Head"), ("loose text", "Head"), ("One", "Head"), ("two l", "Head")]
    md = parse_file("a.md", b"intro\n# T\nx\n## S\ny")
    assert [(b["text"], b["section"]) for b in md["blocks"]] == [("intro", None), ("# T\nx", "T"), ("## S\ny", "S")] and md["metadata"] == {"title": "T"}
    assert decode_text("café".encode("cp1252"))[1] and decode_text("\ufeffa".encode())[0] == "a" and decode_text("é".encode("utf-16"))[0] == "é"
    assert parse_file("a.doc", b"x")["access_status"] == "UNSUPPORTED_FORMAT" and parse_file(None, b"")["format"] == "unknown"
    assert parse_file("b.html", b"<p>a < b <<i>c")["access_status"] == "OK"


def test_captions():
    raw = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.000 align:start\nhello <c>there</c>\n\n00:02.000 --> 00:03.000\nhello there my friend\n\n00:03.000 --> 00:04.000\nmy friend\n\n00:04,000 --> 00:05,000\nnew &amp; old"
    assert caption_lines(raw) == ["[t=00:00:01] hello there", "[t=00:00:02] my friend", "[t=00:00:04] new & old"]
    lines = [f"[t=00:00:{k:02d}] word" for k in range(60)]
    parts = paragraphs(lines, 100)
    assert "\n".join(parts).split("\n") == lines and all(len(p) >= 99 for p in parts[:-1]) and paragraphs([]) == []


def test_files_in_spark(spark, tmp_path):
    (tmp_path / "sub" / ".git").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("one")
    (tmp_path / "sub" / "b.csv").write_text("x,y\n1,2\n")
    (tmp_path / "sub" / ".git" / "c.txt").write_text("hidden")
    files = candidate_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[-1]: r for r in parse_files(files).collect()}
    assert set(got) == {"a.txt", "b.csv"} and [b.text for b in got["b.csv"].blocks] == ["x | y\n1 | 2"]
    assert [r.limitations for r in parse_files(files, max_bytes=1).collect()] == [["FILE_TOO_LARGE"]] * 2
    known = spark.createDataFrame(files.drop("content").collect(), files.drop("content").schema)
    (tmp_path / "a.txt").write_text("other")
    (tmp_path / "d.txt").write_text("new")
    states = {r.path.rsplit("/", 1)[-1]: r.state for r in scan_changes(known, candidate_files(spark, str(tmp_path))).collect()}
    assert states == {"a.txt": "updated", "b.csv": "unchanged", "d.txt": "added"}
    nulls = spark.createDataFrame([(None, None)], "path string, content binary")
    assert parse_files(nulls).first().access_status == "UNSUPPORTED_FORMAT" and parse_files(nulls.limit(0)).count() == 0


def test_source_list(spark):
    lines = ["# note", "https://youtu.be/abcdefghijk | My title", "https://www.youtube.com/@some.one | n: 999", "https://s.example/x", "ftp://s.example/x", '"C:\\docs\\a.pdf"', "| title", ""]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line int, value string")
    got = {r.line: (r.kind, r.target, r.n) for r in parse_source_list(df).collect()}
    assert got == {2: ("youtube_video", "abcdefghijk", None), 3: ("youtube_channel", "@some.one", 200), 4: ("url", "https://s.example/x", None), 5: (None, None, None), 6: ("path", "C:\\docs\\a.pdf", None), 7: (None, None, None)}


def test_payloads(spark):
    one = lambda text: spark.createDataFrame([(text,), (None,), ("broken",)], "payload string")
    w = works(one('{"results":[{"id":"https://openalex.org/W12","doi":"https://doi.org/10.1/AB","display_name":"A <i>t</i>","abstract_inverted_index":{"b":[1],"a":[0,2]},"authorships":[{"author":{"display_name":"X"}}]}]}')).collect()
    assert [(r.title, r.abstract, dict(r.ids)) for r in w] == [("A t", "a b a", {"doi": "10.1/ab", "openalex": "W12"})]
    i = items(one('{"message":{"items":[{"DOI":"10.1/Z","title":["T"],"author":[{"given":"A","family":"B"},{"name":"Org"}],"issued":{"date-parts":[[2020,3]]}}]}}')).collect()
    assert [(r.publication_date, list(r.authors)) for r in i] == [("2020-03", ["A B", "Org"])]
    r = repositories(one('{"items":[{"full_name":"o/r","description":"d","license":{"spdx_id":"NOASSERTION"},"stargazers_count":3,"topics":[],"created_at":"2020-01-01T00:00:00Z","owner":{"login":"o"}}]}')).collect()
    assert r[0].abstract == "d | stars: 3"
    assert [x.url for x in web_results(one('{"results":[{"title":"t","url":"u"},{"title":"no"}]}')).collect()] == ["u"]
    rss = "<rss xmlns:dc='d'><channel><item><title>A &amp;amp; b</title><link>https://s.example/1</link><description>&lt;p&gt;x&lt;/p&gt;</description><dc:creator>N</dc:creator><pubDate>Mon, 01 Jan 2024</pubDate></item></channel></rss>"
    e = feed_entries(one(rss)).collect()
    assert [(x.title, x.abstract, list(x.authors), x.url) for x in e] == [("A & b", "x", ["N"], "https://s.example/1")]
    assert parse_feed('<!DOCTYPE r [<!ENTITY a "b">]><rss/>') == []
    urls = sitemap_urls(one("<urlset><url><loc>https://s.example/blog/two-words.html</loc></url><url><loc>https://s.example/blog/one</loc></url><url><loc>https://other.example/a-b</loc></url></urlset>"), "https://s.example/")
    feed = spark.createDataFrame([("https://s.example/x", "X")], "url string, title string")
    assert sorted(x.url for x in extend_feed(feed, urls).collect()) == ["https://s.example/blog/two-words.html", "https://s.example/x"]
