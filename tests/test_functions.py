import hashlib
import io
import random
import re
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from noticeflow import catalogue
from noticeflow.functions import identity, links, pages, text, urls
from noticeflow.sources import attachments as A
from noticeflow.sources import listings

from .oracle import connect, same


@pytest.fixture(scope="module")
def apply(spark):
    def run(f, *values):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
        return [r[0] for r in df.orderBy("i").select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]

    return run


def test_cleaning(apply):
    assert apply(text.clean, " a&amp;b \n\t c　&#40;d&#41; ", None) == ["a&b c (d)", ""]
    assert apply(text.strip_tags_inline, "<p>a</p><br>b &lt;c&gt;", None) == ["a b <c>", ""]
    assert apply(text.strip_tags_lines, "<style>x</style><p>a</p>\n \n<p>b</p><script>var t='</p>';</script>") == ["\na\nb\n"]


def test_cut_entities_stay_where_only_closed_ones_count(apply, spark, tmp_path):
    assert apply(lambda c: text.strip_tags_inline(c, text.unescape_closed), "a &amp b&amp;c &notit; &am<p> &#40;&quot;", None) == ['a &amp b&c &notit; &am ("', ""]
    spark.createDataFrame([(1, "<p>x &amp</p> y &amp; &copy;"), (2, "&amp;quot; &am")], "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = connect(tmp_path)
    con.execute(f"create or replace view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert same(spark, con, str(tmp_path), catalogue.queries()["page_entities_decoded"], catalogue.oracle_sql()["page_entities_decoded"]) == 2


def test_dates_and_periods(apply):
    assert apply(text.norm_date, "2026.7.1", "2026-07-10 18:00", "26/7/1", " 상시 ", "2026 07 10", None) == ["2026-07-01", "2026-07-10", "2026-07-01", "상시", "2026-07-10", ""]
    assert [tuple(r) for r in apply(text.split_period, "2026.7.1 ~ 2026.8.1", "2026-07-01∼2026-07-02", "상시", "a~b~c")] == [("2026-07-01", "2026-08-01"), ("2026-07-01", "2026-07-02"), ("", "상시"), ("", "a~b~c")]
    assert [tuple(r) for r in apply(text.halves, "2026-07-01 ~ 2026-08-01", "x", "~ y", None)] == [("2026-07-01", "2026-08-01"), (None, None), (None, "y"), (None, None)]


def test_statuses(apply):
    day = F.lit("2026-07-10").cast("date")
    assert apply(lambda c: text.status_by_end(c, day), "2026-07-10", "2026-07-09", "2026-02-30", "", None, "2026-07-11 18:00") == ["접수중", "마감", "불명", "불명", "불명", "접수중"]
    code = lambda c: text.status_by_code(c, F.lit("2026-08-01"), F.lit(None).cast("string"), day)
    assert apply(code, "Y", "신청불가", "상시접수", "예산 소진 시까지", "접수예정", "", None) == ["접수중", "마감", "상시", "예산소진", "회차예정", "접수중", "접수중"]
    period = lambda c: text.status_by_code(F.lit(""), F.lit(None).cast("string"), c, day)
    assert apply(period, "2026-01-01 ~ 2026-07-01", "2026-01-01", None) == ["마감", "불명", "불명"]
    free = [tuple(r) for r in apply(lambda c: text.status_by_deadline(c, day), "연중 상시", "2026년 8월 1일까지", "2026.07.01. 마감", "2026-13-01", "추후 공고", None)]
    assert free == [("상시", None), ("접수중", "2026-08-01"), ("마감", "2026-07-01"), ("불명", None), ("불명", None), ("불명", None)]


def test_hashes(apply, spark):
    assert apply(text.body_hash, "본문 내용") == ["355c109e15e4cf98819d7ad486dbf9bede9ad57079237641b83d98d8b5fd2482"]
    none = F.array().cast("array<string>")
    assert apply(lambda c: text.body_and_files_hash(c, none), "본문 내용") == ["76e5fb30f06e6821ff57c12cd3a8426d1ac20241644a50f4ff7db8e579fd8395"]
    for files in (("b", "a"), ("a", "b")):
        assert apply(lambda c: text.body_and_files_hash(c, F.array(*map(F.lit, files))), "본문") == ["93c33b0601a4cac3cc019205fa228703f6ebcf0c563f184bebab93bb4779ee9e"]


def test_small_ones(apply):
    assert apply(text.split_tags, " 금융, ,기술 ", None) == [["금융", "기술"], []]
    assert apply(text.one_tag, "금융", "", None) == [["금융"], [], []]
    assert apply(lambda c: text.join_filled(c, F.lit(""), F.lit("b")), "a", None) == ["a / b", "b"]
    assert apply(lambda c: text.first_filled(c, F.lit(" z ")), "", "  ", None) == ["z", "", "z"]
    assert apply(text.blocked_page, "<p>CAPTCHA</p>", "x" * 5000 + "captcha") == [True, False]


def test_hosts(apply):
    allowed = lambda c: urls.host_allowed(c, ["bizinfo.go.kr"])
    good = ["https://www.bizinfo.go.kr/a", "https://bizinfo.go.kr", "HTTPS://BIZINFO.go.kr/x"]
    bad = ["https://evilbizinfo.go.kr/", "https://bizinfo.go.kr.evil.example/", "https://bizinfo.go.kr@evil.example/", "http://www.bizinfo.go.kr/", "https://evil.example/?next=bizinfo.go.kr", "", None]
    assert apply(allowed, *good, *bad) == [True] * 3 + [False] * 7
    got = [tuple(r) for r in apply(urls.detail_target, "https://fanfandaero.kr/p?nttId=9", "https://fanfandaero.kr/p?sprtBizCd=77", "https://www.seoulshinbo.co.kr/wbase/bbs/view/12.do", "https://evil.example/?u=fanfandaero.kr&nttId=1")]
    assert got == [("fanfandaero", "ntc-9"), ("fanfandaero", "biz-77"), ("seoulshinbo", "ntc-12"), (None, None)]


def test_robots(apply):
    test = lambda c: urls.robots_allowed(c, ["/upload", "/download"])
    many = "/" + "%" + "25" * 6 + "75ploads"
    denied = ["/%75ploads", "/%2575ploads", "/x/../uploads", "/%2Fuploads", "/%2F%2Fuploads", "/downloadFile.do", "/a%ZZ", "/a%25ZZ", "/%FF", many]
    assert apply(test, *(f"https://h{p}" for p in denied), "https://h//uploads", "https://h/cmm/fms/getFile.do") == [False] * 11 + [True]
    assert urls.path_allowed("https://h/uploads", [])


def test_names(apply, spark):
    safe = lambda c: urls.safe_filename(c, F.lit(0))
    assert apply(safe, "../../etc/passwd", "..\\..\\win.ini", "공고문 (최종).hwp", "", None, "a/b?c*.pdf") == ["00_passwd", "00_win.ini", "00_공고문 (최종).hwp", "00_attach", "00_attach", "00_b_c_.pdf"]
    assert apply(lambda c: urls.safe_filename(c, F.lit(123)), "a") == ["123_a"]
    assert apply(lambda c: urls.safe_filename_by_id(F.lit("0123456789"), c), "x.pdf", "") == ["01234567_x.pdf", "0123456789"]
    assert apply(urls.fix_mojibake, "공고문.hwpx".encode().decode("latin-1"), "plain.pdf", "%EA%B3%B5%EA%B3%A0.pdf", "공고.pdf", None) == ["공고문.hwpx", "plain.pdf", "공고.pdf", "공고.pdf", None]
    assert apply(urls.file_key, "a b/c-d_é") == ["a_b_c_d_é"]
    assert apply(lambda c: urls.redact(c, "k+/="), "x k+/= k%2B/%3D k%2B%2F%3D") == ["x [REDACTED] k%2B/%3D [REDACTED]"]


def test_texts_without_percent_signs_are_repaired_without_python(apply, spark, capsys):
    """As Python does it, for bytes that are and aren't UTF-8; texts go to Python only where there is a percent sign."""

    def plain(name):
        try:
            name = name.encode("latin-1").decode("utf-8")
        except UnicodeError:
            pass
        return urls.unquote(name) if "%" in name else name

    parts = ["a", "é", "공", *(x.encode().decode("latin-1") for x in ("공", "é", "😀")), "%EA%B3%B5", "%zz", "\n", "\xff", "\xed\xa0\x80", "\xc0\xaf", "\xf4\x90\x80\x80", "😀", "Ā", "\xc2\x85"]
    rng = random.Random(1)
    names = ["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(2000))]
    assert apply(urls.fix_mojibake, *names) == list(map(plain, names))
    spark.range(1).select(urls.fix_mojibake(F.col("id").cast("string"))).explain()
    assert re.search(r"ArrowEvalPython \[unquoted\(CASE WHEN Contains", capsys.readouterr().out)


def test_bodies(apply):
    page = '<div id="menu">m</div><div class="a view_cont"><p>본문</p>5<div class="btn_area">b</div><footer>f</footer>'
    assert apply(pages.portal_body, page, "<p>all</p>") == ["\n본문\n5\n".replace("\n5\n", "\n5"), "\nall\n"]
    board = '<div class="sub_cont_wrap">조회수<br>120<br>본문<br>7<br>등록일<br>3<br>다음글'
    assert apply(lambda c: pages.board_body(c, "seoulshinbo"), board) == ["본문\n3"]
    tab = 'title="전체 분야(1,234) 공고보기" id="hashAll"', 'id="hashAll" title="전체 분야(55)', 'title="분야(7) 공고보기" title="분야(9) 공고보기"', "nothing"
    assert apply(pages.announced_total, *tab) == [1234, 55, 9, None]
    assert apply(pages.last_page, "cpage=2 cpage=96 cpage=3", "") == [96, 0]
    links = apply(lambda c: pages.portal_links(c, "https://b"), '<a href="/cmm/fms/getFile.do?a=1&amp;b=2">x</a><a href="/uploads/f/공고.pdf?v=1">', "none")
    assert [[tuple(x) for x in r] for r in links] == [[("https://b/cmm/fms/getFile.do?a=1&b=2", "getFile.do"), ("https://b/uploads/f/공고.pdf?v=1", "공고.pdf")], []]


ONE, TWO = "PBLN_111", "PBLN_222"


def own(i):
    return f"var altUrl = location.origin + location.pathname + '?pblancId={i}';"


@pytest.mark.parametrize(
    "script,ids",
    [
        (own(ONE), [ONE]),
        (f'var s="{own(ONE)}"; {own(TWO)}', [TWO]),
        (f"function ready(){{ {own(ONE)} }}", [ONE]),
        (own(ONE) + own(TWO), [ONE, TWO]),
        (f"var altUrl = (function(){{return '?pblancId={ONE}'}})();", None),
        (f"var altUrl = '?pblancId={ONE}';", None),
        (f"var altUrl = c ? '?pblancId={ONE}' : '';", None),
        (f"const f = altUrl => '?pblancId={ONE}';", []),
        (f"var re = /altUrl=.?pblancId={ONE}/;", []),
        (f"alt</script><script>Url='?pblancId={ONE}'", []),
        (f"// {own(ONE)}", []),
        (f"/* {own(ONE)} */ x = 1 / 2; {own(TWO)}", [TWO]),
        (own(ONE)[4:], []),
        (f"o.{own(ONE)[4:]}", []),
        (f"var altUrl = // '?pblancId={TWO}'\n location.origin + location.pathname + '?pblancId={ONE}';", [ONE]),
    ],
)
def test_page_ids(script, ids):
    assert identity.page_ids(f"<script>{script}</script>", "bizinfo") == ids


def test_page_ids_of_boards(apply):
    page = lambda s: identity.page_ids(s, "fanfandaero")
    assert page("<script>var nttId = /* 1 */ '5002';</script>") == ["5002"] and page("<script>var nttId = (1,2);</script>") is None
    assert page('<input name="nttId" value=" 7 "><!-- <input name="nttId" value="8"> -->') == ["7"]
    assert identity.page_ids('<link rel="canonical" href="/bbs/view/0012.do"><a href="/bbs/view/13.do">', "seoulshinbo") == ["12"]
    match = lambda c: identity.is_page_of(c, "bizinfo", F.lit(ONE))
    assert apply(match, f"<script>{own(ONE)}</script>", f"<script>{own(TWO)}</script>", "", None) == [True, False, False, False]


def hwpx(sections):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n, t in sections.items():
            z.writestr(f"Contents/section{n}.xml", f'<a xmlns:hp="urn:hp"><hp:t>{t}</hp:t></a>')
        z.writestr("mimetype", "x")
    return out.getvalue()


def compound(text):
    """A compound file of one small stream."""
    raw = text.encode("utf-16-le")

    def entry(name, kind, start, size):
        n = (name + "\0").encode("utf-16-le")
        return n.ljust(64, b"\0") + struct.pack("<HB", len(n), kind) + b"\0" * 49 + struct.pack("<II", start, size) + b"\0" * 4

    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    small = -(-len(raw) // 64)
    head = bytearray(512)
    head[:8] = A.COMPOUND
    struct.pack_into("<HH", head, 30, 9, 6)
    struct.pack_into("<7I", head, 48, 1, 0, 4096, 2, 1, end, 0)
    struct.pack_into("<109I", head, 76, 0, *[free] * 108)
    fat = struct.pack("<128I", 0xFFFFFFFD, end, end, *[4 + i for i in range(-(-small // 8) - 1)], end, *[free] * (128 - 4 - (-(-small // 8) - 1)))
    directory = (entry("Root Entry", 5, 3, small * 64) + entry("PrvText", 2, 0, len(raw))).ljust(512, b"\0")
    minifat = struct.pack("<128I", *range(1, small), end, *[free] * (128 - small))
    return bytes(head) + fat + directory + minifat + raw.ljust(-(-small // 8) * 512, b"\0")


def test_extraction(spark):
    assert A.extract("a.hwpx", hwpx({10: "c", 2: "b", 0: "a"})) == (True, "a\nb\nc", "")
    assert A.extract("a.hwp", hwpx({0: "x"})) == (True, "x", "")
    assert A.extract("a.hwpx", hwpx({})) == (False, "", "hwpx_no_sections") and A.extract("a.hwpx", b"PK")[2].startswith("hwpx_error")
    assert A.extract("a.xyz", b"1") == (False, "", "unsupported_extension") and A.extract("a.pdf", None) == (False, "", "file_not_found")
    assert A.extract("x.hwp", compound("미리보기 " * 60)) == (True, ("미리보기 " * 60).strip(), "hwp_preview_only")
    assert A.extract("wrong.txt", compound("짧은 글"))[1] == "짧은 글" and A.extract("x.doc", compound("a"))[2] == "unsupported_extension"
    forged = bytearray(compound("a"))
    struct.pack_into("<I", forged, 72, 0xFFFFFFFF)
    struct.pack_into("<I", forged, 68, 0)
    assert A.extract("x.hwp", bytes(forged))[2] in ("hwp_preview_only", "hwp_binary_unsupported")
    assert A.extract("x.hwp", A.COMPOUND)[2] == "hwp_binary_unsupported"
    df = spark.createDataFrame([("a.hwpx", hwpx({0: "t"})), ("b.hwp", compound("p")), ("c.xyz", b""), ("d.hwpx", b"no")], "name string, content binary")
    rows = df.withColumn("r", A.extracted(F.col("name"), F.col("content"))).select("name", A.extract_status(F.col("r")).alias("s"), A.text_with_note(F.col("r")).alias("t")).orderBy("name").collect()
    assert [r.s for r in rows] == ["ok", "partial", "unsupported", "failed"] and rows[1].t.startswith("[HWP_PREVIEW_ONLY")


def test_files(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/one.txt").write_bytes(b"1")
    (tmp_path / "x/two.txt").write_bytes(b"22")
    rows = A.read_files(spark, str(tmp_path), most=1).collect()
    assert [(r.name, r.sha256) for r in rows] == [("one.txt", hashlib.sha256(b"1").hexdigest())]
    df = spark.createDataFrame([("d", "공고.hwp", "h1", 1), ("d", "공고.hwp", "h2", 2), ("d", "공고.hwp", "h1", 3), ("e", "공고.hwp", "h3", 1), ("d", "n", "a", 1), ("d", "n", "b", 5)], "folder string, name string, h string, t int")
    got = sorted((r.folder, r.t, r.stored_name) for r in A.stored_names(df, "folder", "name", "h", "t").collect())
    assert got == [("d", 1, "n"), ("d", 1, "공고.hwp"), ("d", 2, "공고-1.hwp"), ("d", 3, "공고.hwp"), ("d", 5, "n-1"), ("e", 1, "공고.hwp")]


def test_board_links(apply):
    link = "https://fanfandaero.kr/download.do?fileName=/a/b/x1.hwp"
    page = f'<a href="{link}">f</a><a href="{link}">f</a> view("fileName=/a/b/x1.hwp&x=1", "2", "공고 &amp; 안내.hwp") <a href="{link}2">'
    assert links.fanfan_links(page) == [(link, "공고 & 안내.hwp"), (link + "2", "x1.hwp2")]
    board = """<a onclick="common.download(1, 'ab-1')"><span class="e">붙임%201.hwp</span></a><a onclick="common.download(1,'cd-2')"><img alt=""> 둘.pdf</a><a onclick="common.download(1, 'ab-1')">"""
    got = apply(lambda c: links.board_links(c, "seoulshinbo", F.lit("12")), board, None)
    assert [[x.filename for x in r] for r in got] == [["붙임 1.hwp", "둘.pdf"], []] and got[0][0].url.endswith("/download/12/ab-1.do?mng_cd=STRY9788")


def test_links_of_the_doubled_board_need_no_pattern_of_their_own(monkeypatch):
    """Names are those that a search for each serial gives, by patterns that are compiled once."""
    call, text_ = r"""common\.download\(\s*\d+\s*,\s*'%s'\)"[^>]*>""", r"\s*([^<]+)"
    bits = ["common.download(1, 'ab-1'", "common.download( 7 ,'c'", ")\"", ")\" class=\"b\"", ">", "<span>", "x+y", " \n", '<img alt="">', 'alt="" >', "<", "&amp;", "'"]
    rng = random.Random(1)
    made = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 20))) for _ in range(2000)]
    made += [f"<a onclick=\"common.download(1, 'ab-{i:x}')\"><span>n{i}</span>" for i in range(3)]
    want = []
    for page in made:
        found = [(s, re.search(call % s + r"\s*<span[^>]*>([^<]+)", page) or re.search(call % s + r'[\s\S]*?alt=""\s*>' + text_, page)) for s in dict.fromkeys(links.SSB_LINK.findall(page))]
        want.append([(links.SSB_FILE.format(post="9", serial=s), links.unquote_plus(links.tidy(m[1])) if m else s) for s, m in found])
    monkeypatch.setattr(links.re, "search", None)
    assert [links.ssb_links(page, "9") for page in made] == want


def test_plain_pages_are_read_as_the_parser_reads_them():
    bits = ['<link rel="canonical" href="/bbs/view/07.do">', '<LINK href="/view/8.do" REL="Canonical" />', "<link rel='canonical' href='/view/3.do'>", "<!-- ", "-->", "<script>", "</script>", "<br/>", '<a title="x > y">', "<", '"', "text", '<link rel="canonical" href="/view/&#49;2.do">']
    rng = random.Random(1)
    pages_ = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 5))) for _ in range(3000)]
    assert all(identity.page_ids(p, "seoulshinbo") == sorted(map(str, identity.marks(p).views)) for p in pages_)
    assert identity.plain_views(bits[0] + bits[1]) == {7, 8} and identity.plain_views(bits[3] + bits[0] + bits[4]) is None


def test_listing_patterns_match_across_lines_by_dots(apply):
    """As the slow class of all characters would."""
    page = '<tr>\n<td>1\u2028</td><td x>\r\n a</td><td><a href = "/v?pblancId=PBLN_7&m" class="l">\n n\r\u0085m </a></td></tr><tr>x</tr>'
    for pattern, group in ((listings.PORTAL_ROW, 0), (listings.PORTAL_LINK, 3), (listings.CELL, 1)):
        slow = pattern.replace("(?s)", "").replace(".*?", r"[\s\S]*?")
        assert "(?s)" in pattern and apply(lambda c: F.regexp_extract_all(c, F.lit(pattern), group), page) == apply(lambda c: F.regexp_extract_all(c, F.lit(slow), group), page) != [[]]
    assert not any(r"[\s\S]" in p for p in (listings.PORTAL_ROW, listings.PORTAL_LINK, listings.CELL, listings.FANFAN_POST, listings.SSB_POST))


def test_stored_names_never_take_the_place_of_another(spark):
    rows = [("d", "a.pdf", "h1", 1), ("d", "a.pdf", "h2", 2), ("d", "a-1.pdf", "h3", 3), ("d", "a-1.pdf", "h2", 4), ("d", "a.pdf", "h3", 5), ("d", "a.pdf", "h1", 6), (None, "a.pdf", "h9", 1), ("d", None, "h4", 7), ("d", "attach", "h5", 8), ("d", "x", None, 9)]
    df = spark.createDataFrame(rows, "folder string, name string, digest string, at int")
    got = {(r.folder, r.name, r.digest, r.at): r.stored_name for r in A.stored_names(df, "folder", "name", "digest", "at").collect()}
    assert [got[r] for r in rows] == ["a.pdf", "a-1.pdf", "a-1-1.pdf", "a-1.pdf", "a-2.pdf", "a.pdf", "a.pdf", "attach", "attach-1", None]
    import random

    rng = random.Random(1)
    for _ in range(300):
        names, own = A.Names(), {}
        for _ in range(25):
            name, content = rng.choice(["a.b", "a-1.b", "a-2.b", "a-1-1.b", "c", "c-1", "a.1-1"]), rng.choice("uvwxyz")
            n = 0
            while (form := A.numbered(name, n)) in own and own[form] != content:
                n += 1
            own[form] = content
            assert names.give(name, content) == form
