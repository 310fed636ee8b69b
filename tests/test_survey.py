import json

import pytest
from pyspark.sql import functions as F

from noticeflow import schema
from noticeflow.operators import coverage, dedup, diff, paging, report, upsert
from noticeflow.operators.components import components
from noticeflow.plans import survey
from noticeflow.sources import listings, sinks, snapshots
from noticeflow.streaming import ingest

DAY = NOW = None


@pytest.fixture(scope="module", autouse=True)
def survey_day(spark):
    """Columns need a session, so the survey's date and time are made once there is one."""
    global DAY, NOW
    DAY, NOW = F.lit("2026-07-10").cast("date"), F.lit("2026-07-10T00:00:00+09:00")


def land(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, content in files.items():
        text = content if isinstance(content, str) else json.dumps(content, ensure_ascii=False)
        (folder / (name + (".html" if isinstance(content, str) else ".json"))).write_text(text, encoding="utf-8")
    return str(folder)


def envelope(total, *items):
    return {"result": True, "data": {"default": {"total": total, "list": list(items), "page": {}}}}


def notice(sn, **more):
    return {"pbancSn": sn, "pbancNm": f"공고 {sn}", "rcptPd": {"from": "2026-07-01", "to": "2026-08-01"}, "aplyPsbltySe": "Y", "hstgNm": "금융, 기술", **more}


def cover(listing):
    return listing.coverage.first().asDict()


def test_json_list(spark, tmp_path):
    path = land(tmp_path / "p", page1=envelope(3, notice(101), notice(102, regionNmList="부산", ddlnDayCnt=5)), page2=envelope(3, notice(102, pbancNm="later")))
    got = survey.sbiz(spark, path, "pbanc", DAY, NOW)
    rows = {r.source_id: r for r in got.rows.collect()}
    assert set(rows) == {"101", "102"} and rows["102"].title == "공고 102"
    assert (rows["101"].region_scope, rows["102"].region_scope, rows["101"].tags, rows["102"].raw["ddlnDayCnt"]) == ("전국", "부산", ["금융", "기술"], "5")
    assert (rows["101"].status, rows["101"].apply_end, rows["101"].attachments, rows["101"].attachments_complete) == ("접수중", "2026-08-01", [], False)
    c = cover(got)
    assert (c["total"], c["fetched"], c["collected"], c["duplicates"], c["outcome"], c["exit_code"]) == (3, 3, 2, 1, "partial", 2)
    assert cover(survey.sbiz(spark, path, "pbanc", DAY, NOW, max_pages=1))["outcome"] == "success"
    assert cover(survey.sbiz(spark, land(tmp_path / "e", page1=envelope(3)), "pbanc", DAY, NOW))["outcome"] == "failed"


def test_combined_list(spark, tmp_path):
    items = [notice(None, pbancId="PBLN_1", aplyPd="2026-07-01 ~ 2026-07-05", aplyPsbltySe="", rcptPd=None, departNm="부처"), notice(7, pbancGubun="C", aplyPsbltySe="상시"), notice(8, pbancGubun="A", rcrtTypeCdNm="유형")]
    rows = {r.source_id: r for r in survey.sbiz(spark, land(tmp_path / "c", page1=envelope(3, *items)), "combine", DAY, NOW).rows.collect()}
    assert (rows["PBLN_1"].announce_no, rows["PBLN_1"].status, rows["PBLN_1"].apply_end, rows["PBLN_1"].agency) == ("PBLN_1", "마감", "2026-07-05", "부처")
    assert [rows[k].canonical_url.split("#")[1] for k in ("PBLN_1", "7", "8")] == ["/extldPbanc/PBLN_1", "/loanProduct/7", "/pbanc/8"]
    assert rows["7"].agency == "미상" and rows["8"].agency == "유형" and rows["7"].status == "상시"


def row(number, name, period, *more):
    cells = ["1", "금융", f'<a href="/v.do?pblancId={number}" title="x">{name}</a>', period, *more]
    return "<tr>" + "".join(f"\n<td>{c}</td>" for c in cells) + "</tr>"


def portal(total, pages, *rows):
    return f'<a title="전체 분야({total}) 공고보기" id="hashAll">x</a><table><tr><th>h</th></tr>{"".join(rows)}</table>' + "".join(f'<a href="?cpage={p}">' for p in pages)


def test_portal(spark, tmp_path):
    first = portal("2", [1, 2], row("PBLN_1", "가 &amp; 나", "2026-07-01 ~ 2026-07-31", "부처", "기관", "2026-07-01", "9"), row("PBLN_2", "다", "예산 소진 시까지"))
    second = portal("2", [1, 2], row("PBLN_1", "새 제목", "2026.6.1 ~ 2026.6.30", "부처", "", "2026-07-01", "9"))
    got = survey.bizinfo(spark, land(tmp_path / "b", p1=first, p2=second), DAY, NOW)
    rows = {r.source_id: r for r in got.rows.collect()}
    assert (rows["PBLN_1"].title, rows["PBLN_1"].agency, rows["PBLN_1"].status, rows["PBLN_1"].page) == ("새 제목", "부처", "마감", 1)
    assert (rows["PBLN_2"].apply_start, rows["PBLN_2"].apply_end, rows["PBLN_2"].status, rows["PBLN_2"].agency) == (None, "예산 소진 시까지", "불명", "")
    assert rows["PBLN_1"].raw == {"field": "금융", "reg_date": "2026-07-01"} and cover(got)["outcome"] == "success"
    assert cover(survey.bizinfo(spark, land(tmp_path / "b2", p1=first.replace("(2)", "(3)"), p2=second), DAY, NOW))["outcome"] == "partial"
    assert cover(survey.bizinfo(spark, land(tmp_path / "b3", p1=first), DAY, NOW))["outcome"] == "partial"
    assert cover(survey.bizinfo(spark, land(tmp_path / "b4", p1="<p>nothing</p>"), DAY, NOW))["outcome"] == "failed"


def post(number, name, date):
    return f"""<li><a href="#" onclick="detailPage('{number}');" class="title">{name}</a>\n<span class="date">{date}</span></li>"""


def test_board_with_years(spark, tmp_path):
    def year(*items):
        return {"years": ["2026", "2025"], "list": [{"sprtBizCd": c, "sprtBizNm": n, "rcritEndYmd": "2026-07-31"} for c, n in items]}

    programmes = land(tmp_path / "y", year0=year(("1", "a"), ("", "none")), year1=year(("1", "b"), ("2", "c")))
    board = land(tmp_path / "n", p1='<script>var totalRecordCount = "3";</script>' + post(9, "x", "2026.07.10") + post(8, "y", "2026.07.05"), p2=post(9, "x", "2026.07.10") + post(7, "z", "2026.06.01"), p3=post(6, "w", "2026.05.01"))
    got = survey.fanfan(spark, programmes, board, DAY, NOW)
    rows = {r.source_id: r for r in got.rows.collect()}
    assert set(rows) == {"biz-1", "biz-2", "ntc-9", "ntc-8", "ntc-7", "ntc-6"} and rows["biz-1"].title == "a"
    assert rows["ntc-9"].raw["posted"] == "2026-07-10" and rows["ntc-9"].status == "불명" and rows["biz-2"].status == "접수중"
    cut = survey.fanfan(spark, programmes, board, DAY, NOW, since="2026-07-01")
    empty = survey.fanfan(spark, programmes, land(tmp_path / "n0", p1="<p>changed</p>", p2=post(9, "x", "2026.07.10")), DAY, NOW)
    assert cover(empty)["outcome"] == "partial"
    assert {r.source_id for r in cut.rows.collect()} == {"biz-1", "biz-2", "ntc-9", "ntc-8", "ntc-7"} and cover(cut)["outcome"] == "success"


def test_board_with_doubled_markup(spark, tmp_path):
    def line(n, dept="지원부"):
        return f"""<tr><td class="title"><a href="#" onclick="goView('1', '{n}')"><span class="ellipsis">공고 {n}</span></a></td><td>{dept}</td><td>2026.07.15</td></tr>"""

    board = land(tmp_path / "s", p1="".join(line(n) * 2 for n in range(6)), p2=line(10, "") + line(11), p3=line(12))
    got = survey.ssb(spark, board, NOW)
    rows = {r.source_id: r for r in got.rows.collect()}
    assert len(rows) == 9 and rows["ntc-0"].agency == "서울신용보증재단/지원부" and rows["ntc-10"].agency == "서울신용보증재단"
    assert rows["ntc-0"].raw["posted"] == "2026-07-15" and cover(got)["thin"] == 1 and cover(got)["outcome"] == "partial"


def test_open_api(spark, tmp_path):
    def service(i, name, **more):
        return {"서비스ID": i, "서비스명": name, "신청기한": "상시신청", "소관기관명": "기관", "지원유형": "현금", **more}

    data = [service("1", "소상공인 지원"), service("2", "기타", 지원대상="소상", 지원내용="공인"), {"서비스명": "no id"}, service("1", "소상공인 새 이름")]
    pages = land(tmp_path / "g", page1={"totalCount": 4, "data": data})
    got = survey.gov24(spark, pages, DAY, NOW)
    rows = {r.source_id: r for r in got.rows.collect()}
    assert set(rows) == {"1", "2"} and rows["1"].title == "소상공인 새 이름" and rows["1"].pos == 0
    assert (rows["1"].status, rows["1"].agency, rows["1"].attachments_complete, rows["1"].tags) == ("상시", "기관", True, ["현금"])
    assert cover(got)["outcome"] == "partial" and cover(survey.gov24(spark, pages, DAY, NOW, needle="소상 공인"))["outcome"] == "success"
    assert [r.source_id for r in survey.gov24(spark, pages, DAY, NOW, needle="소상 공인").rows.collect()] == ["2"]
    for total, rows_ in ((10, []), (0, []), (1, [{"x": "1"}])):
        assert cover(survey.gov24(spark, land(tmp_path / f"g{total}", page1={"totalCount": total, "data": rows_}), DAY, NOW))["outcome"] == "failed"


def test_api_hash(spark):
    import hashlib

    item = {"서비스ID": "1", "서비스명": ' 이름 "x"\n', "신청기한": "", "지원대상": "a"}
    want = {k: next((str(item[a]).strip() for a in keys if item.get(a) not in (None, "")), None) for k, keys in listings.FIELD_KEYS.items()}
    digest = hashlib.sha256(json.dumps(want, ensure_ascii=False, sort_keys=True).encode()).hexdigest()
    df = spark.createDataFrame([(item,)], "item map<string,string>")
    assert df.select(listings.gov24_hash(F.col("item"))).first()[0] == digest


@pytest.fixture(scope="module")
def record(spark):
    def make(*rows):
        base = {"source": "s", "title": "t", "status": "접수중"}
        return spark.createDataFrame([tuple({**base, **r}.get(f) for f in schema.ANNOUNCEMENT.names) for r in rows], schema.ANNOUNCEMENT)

    return make


def kinds(compared):
    return {r.source_id: (r.kind, r.changed_fields) for r in compared.collect()}


def test_diff_cases(record):
    one = {"source_id": "1"}

    def case(old, new, **options):
        return kinds(diff.compare(record({**one, **old}), record({**one, **new}), **options))["1"]

    h = lambda d, v=2: {"content_hash": d, "hash_version": v}
    assert case(h("a", 1), h("b", 2)) == ("CHANGED", [diff.FORMULA_CHANGE])
    assert case(h("b"), h("b")) == ("UNCHANGED", []) and case(h("a"), h("c", 3)) == ("CHANGED", [diff.FORMULA_CHANGE])
    assert case(h("a"), h("b")) == ("CHANGED", ["content_hash"]) and case(h("a"), {}) == ("NEEDS_REHASH", [])
    assert case({}, h("a")) == ("UNCHANGED", []) and case({"apply_end": ""}, {"apply_end": None}) == ("UNCHANGED", [])
    assert case({**h("a", 1), "title": "x"}, {**h("b"), "agency": "y"}) == ("CHANGED", ["title", "agency"])
    assert case({}, {}, invalidate=True) == ("NEW", [])


def test_diff_of_sources(record, spark):
    old = record({"source_id": "1"}, {"source_id": "2"}, {"source": "fanfandaero", "source_id": "3"}, {"source": "away", "source_id": "4"})
    new = record({"source_id": "1"}, {"source_id": "5"}, {"source": "fanfandaero", "source_id": "6"})
    got = diff.compare(old, new)
    assert {k: v[0] for k, v in kinds(got).items()} == {"1": "UNCHANGED", "2": "GONE", "3": "GONE", "5": "NEW", "6": "NEW"}
    assert "3" not in kinds(diff.compare(old, new, incremental=["fanfan"]))
    assert {k: v[0] for k, v in kinds(diff.compare(old, new, invalidate=True)).items()}["2"] == "GONE"
    assert [r.source for r in diff.missing_sources(old, new).collect()] == ["away"]
    assert {r.kind: r.n for r in diff.summary(got).collect()} == {"NEW": 2, "CHANGED": 0, "NEEDS_REHASH": 0, "UNCHANGED": 1, "GONE": 2}
    same = diff.compare(new, new.repartition(3))
    assert {r.kind for r in same.collect()} == {"UNCHANGED"}


def test_snapshot_folders(spark, tmp_path):
    def write(name, *rows):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows), encoding="utf-8")

    row = {"source": "s", "source_id": "1", "title": "t", "raw": {"n": 5}}
    write("old/s.jsonl", row, {"kind": "NEW", "record": row}, {"screening": "candidate", "source": "s", "source_id": "9"})
    write("old/screening.jsonl", {"source": "s", "source_id": "8", "title": "x"})
    write("old/new_items2.jsonl", {"source": "s", "source_id": "7", "title": "x"})
    write("new/s.jsonl", {**row, "title": "u"}, {**row, "source_id": 2})
    old = snapshots.read_snapshot(spark, str(tmp_path / "old"))
    assert [(r.source_id, r.raw, r.hash_version) for r in old.collect()] == [("1", {"n": "5"}, None)]
    got = survey.compare_surveys(spark, str(tmp_path / "old"), str(tmp_path / "new"))
    assert {k: v[0] for k, v in kinds(got).items()} == {"1": "CHANGED", "2": "NEW"}
    summary = sinks.write_diff(got, str(tmp_path / "out"))
    assert {r.kind: r.n for r in summary.collect()}["CHANGED"] == 1
    written = [json.loads(x) for p in (tmp_path / "out/review").glob("*.json") for x in p.read_text(encoding="utf-8").splitlines()]
    assert {(w["kind"], w["diff_status"], w["record"]["source_id"]) for w in written} == {("CHANGED", "CHANGED", "1"), ("NEW", "NEW", "2")}
    write("bad/s.jsonl", row, row)
    write("none/s.jsonl", {"source": "s", "title": "t"})
    for folder in ("bad", "none"):
        with pytest.raises(snapshots.SnapshotError):
            survey.compare_surveys(spark, str(tmp_path / "old"), str(tmp_path / folder))


def test_profiles():
    good = "---\nentity_type: 개인\nneeds:\n  - a # x\n  - b\nindustry_text: C# 학원\n# c\n---\nbody"
    assert snapshots.parse_profile(good) == {"entity_type": "개인", "needs": "- a | - b", "industry_text": "C"}
    empty = "---\nother: 1\n---"
    invalid = snapshots.carry_over_invalid
    assert not invalid(None, None) and not invalid(good, good) and invalid(good, None) and invalid(empty, empty) and invalid(good, good.replace("개인", "법인")) and invalid("x", "x")


def test_upsert_rules(record, spark):
    rows = record(*({"source": s, "source_id": "1", "content_hash": "o", "hash_version": 2, "raw": {"pbancGubun": g, "k": "v"}} for s, g in (("sbiz24", "A"), ("sbiz24_combine", "C"), ("fanfandaero", None), ("gov24", None), ("bizinfo", None))))
    details = spark.createDataFrame(
        [("sbiz24", "1", None, None, None, None), ("sbiz24_combine", "1", "n", 2, "A", None), ("fanfandaero", "1", None, None, None, None), ("gov24", "1", "n", None, None, {"k": "w"}), ("bizinfo", "1", "n", 3, None, None), ("x", "9", "n", 2, None, None)],
        "source string, source_id string, content_hash string, hash_version int, namespace string, raw map<string,string>",
    )
    got = {r.source: (r.content_hash, r.hash_version, r.raw["k"]) for r in upsert.upsert(rows, details).collect()}
    assert got == {"sbiz24": (None, None, "v"), "sbiz24_combine": ("o", 2, "v"), "fanfandaero": (None, 2, "v"), "gov24": ("n", 2, "w"), "bizinfo": ("n", 3, "v")}
    assert upsert.upsert(rows, details).schema == rows.schema
    assert [r.source_id for r in upsert.unmatched(rows, details).collect()] == ["9"]
    assert upsert.lookup(rows, "gov24", "1").count() == 1


def test_refused_details(record, spark):
    gubun = lambda g, **more: {"pbancGubun": g, **more}
    rows = record(*({"source_id": str(i), "title": "a &#40;b&#41;", "raw": r} for i, r in enumerate([gubun("A"), gubun("C"), {}, gubun("D", bizType="대출상품"), gubun("A"), gubun("A")])))
    requests = spark.createDataFrame([(str(i),) for i in range(7)], "source_id string")
    answers = spark.createDataFrame([(str(i), "9" if i == 4 else str(i), "other" if i == 5 else "a  (b)") for i in range(7)], "source_id string, returned_id string, title string")
    got = {r.source_id: r.refused for r in upsert.accepted_details(rows, requests, answers).collect()}
    assert got == {"0": None, "1": "namespace without details", "2": "namespace without details", "3": "contradictory kind", "4": "answer of another id", "5": "answer of another title", "6": "no listing row"}


def test_detail_pages(record, spark, tmp_path):
    own = "<script>var altUrl = location.origin + location.pathname + '?pblancId=PBLN_1';</script>"
    body = f'{own}<div class="view_cont"><p>본문</p></div><a href="/uploads/a.hwpx">f</a><footer>'
    pages = spark.createDataFrame([("PBLN_1", body), ("PBLN_2", body)], "source_id string, body string")
    details = survey.portal_details(pages)
    rows = {r.source_id: r for r in details.collect()}
    assert rows["PBLN_1"].accepted and not rows["PBLN_2"].accepted and rows["PBLN_1"].links[0].filename == "a.hwpx"
    files = spark.createDataFrame([("PBLN_1", ("a.hwpx", "ok", "h"))], "source_id string, attachment struct<filename: string, extract_status: string, sha256: string>")
    both = {r.source_id: r for r in survey.with_attachments(details, files).collect()}
    assert both["PBLN_1"].hash_version == 3 and both["PBLN_1"].attachments_complete and both["PBLN_2"].hash_version == 2
    failed = files.withColumn("attachment", F.col("attachment").withField("extract_status", F.lit("failed")))
    assert survey.with_attachments(details, failed).where("source_id = 'PBLN_1'").first().content_hash == rows["PBLN_1"].content_hash
    assert survey.with_attachments(details, failed, portal=False).where("source_id = 'PBLN_1'").first().content_hash is None
    listing = record({"source": "bizinfo", "source_id": "PBLN_1"}, {"source": "bizinfo", "source_id": "PBLN_2"})
    merged = {r.source_id: r.content_hash for r in survey.merge(listing, details).collect()}
    assert merged == {"PBLN_1": rows["PBLN_1"].content_hash, "PBLN_2": None}
    board = spark.createDataFrame([("ntc-12", '<link rel="canonical" href="/bbs/view/12.do"><div class="sub_cont_wrap">본문</div>')], "source_id string, body string")
    detail = survey.board_details(board, "seoulshinbo").first()
    assert detail.accepted and detail.links == [] and detail.attachments_complete
    sinks.write_details(details.withColumn("url", F.lit("u")).withColumn("attachments", F.col("links")).withColumnRenamed("text", "body"), str(tmp_path / "d"))
    assert "CONTENT_HASH" in spark.read.parquet(str(tmp_path / "d")).first().text


def test_sbiz_details(spark, tmp_path):
    detail = envelope(0)
    detail["data"]["default"] = {"pbancSn": 5, "pbancNm": "이름", "pbancDtlCn": "<p>a</p> &amp; b", "rcptPd": {"from": "2026-07-01", "to": ""}, "pbancSttsCd": "1"}
    r = listings.sbiz_detail(listings.read_json_pages(spark, land(tmp_path / "d", d1=detail), schema.DETAIL)).first()
    assert (r.source_id, r.body_text, r.apply_start, r.apply_end) == ("5", "a & b", "2026-07-01", None)
    files = {"data": {"default": {"list": [{"fileId": "f1", "fileNm": "a.hwp", "fileSz": 3}, {"fileNm": "x"}]}}}
    got = listings.sbiz_files(listings.read_json_pages(spark, land(tmp_path / "f", d1=files), schema.FILES).withColumn("sn", F.lit(5)), "sn").collect()
    assert [(f.file_id, f.filename, f.size, f.pbanc_sn) for f in got] == [("f1", "a.hwp", 3, "5")]


def test_api_details(spark, tmp_path):
    pages = land(tmp_path / "a", d1={"data": [{"svcId": "1", "서비스명": "n"}]})
    rows = listings.read_json_pages(spark, pages, schema.API_PAGE)
    got = listings.gov24_details(rows.withColumn("want", F.lit("1")).unionByName(rows.withColumn("want", F.lit("2"))), "want").collect()
    assert {r.source_id: r.matched for r in got} == {"1": True, "2": False} and got[0].raw == {"title": "n"}


def test_keep_rules(spark):
    rows = spark.createDataFrame([("a", 1, 0, "x"), ("b", 1, 1, "y"), ("a", 2, 0, "z")], "k string, page int, pos int, v string")
    assert sorted(map(tuple, dedup.keep_first(rows, ["k"], ["page", "pos"]).collect())) == [("a", 1, 0, "x"), ("b", 1, 1, "y")]
    assert sorted(map(tuple, dedup.keep_last(rows, ["k"], ["page", "pos"]).collect())) == [("a", 1, 0, "z"), ("b", 1, 1, "y")]


def test_stops(spark):
    rows = spark.createDataFrame([(1, "a", "2026-07-02"), (2, "a", "2026-07-02"), (3, "b", "2026-01-01")], "page int, k string, posted string")
    assert {r.page for r in paging.until_stop(rows, ["k"]).collect()} == {1, 2}
    dated = spark.createDataFrame([(1, "a", "2026-07-02"), (2, "b", "2026-01-01"), (2, "c", "unknown"), (3, "d", "2026-01-01"), (4, "e", "2026-01-01")], "page int, k string, posted string")
    assert {r.page for r in paging.until_stop(dated, ["k"], F.col("posted"), "2026-06-01").collect()} == {1, 2, 3}
    assert paging.until_stop(rows.limit(0), ["k"]).count() == 0


def test_report(record, spark):
    rows = record({"source_id": "1", "status": "예산소진"}, {"source_id": "2", "apply_end": "2026-07-12"}, {"source": "gov24", "source_id": "3", "status": "상시"}, {"source_id": "4", "apply_end": "2026-07-11", "status": "불명"})
    listed = report.ordered(report.deadline_list(rows, DAY)).collect()
    assert [(r.source_id, r.section, r.days_left) for r in listed] == [("4", "deadlines", 1), ("2", "deadlines", 2), ("1", "deadlines", None), ("3", "services", None)]
    verdicts = spark.createDataFrame([("s", "1", "조건부"), ("s", "1", "조건부"), ("s", "2", "확인됨"), ("s", "4", "확인됨")], "source string, source_id string, verdict string")
    got = {(r.source_id, r.rule) for r in report.verdict_errors(rows, verdicts).collect()}
    assert got == {("1", "one verdict"), ("2", "unread attachment"), ("4", "unread attachment"), ("4", "unknown status")}
    screened = spark.createDataFrame([("s", "1", "candidate"), ("s", "2", "excluded")], "source string, source_id string, screening string")
    outcomes = spark.createDataFrame([("s", "success"), ("gov24", "partial")], "source string, collection_status string")
    made = report.manifest(rows, screened, outcomes)
    assert {r.source: (r.screening_status, r.collected, r.screened, r.candidate) for r in made.collect()} == {"s": ("partial", 3, 2, 1), "gov24": ("partial", 1, 0, 0)}
    assert report.manifest_errors(made).count() == 0 and report.manifest_errors(made.withColumn("screened", F.lit(9))).count() == 2
    assert [r.source_id for r in report.needs_detail(rows).collect()] == ["4"] and report.screening_gap(rows, screened).count() == 2
    flags = spark.createDataFrame([(True, False, False, False), (False, True, True, False), (False, True, False, True), (False, False, False, False)], "a boolean, b boolean, c boolean, d boolean")
    assert [r[0] for r in flags.select(report.small_business_status(*map(F.col, "abcd"))).collect()] == ["confirmed", "confirmed", "needs_check", "unknown"]


def test_outcomes(spark):
    one = spark.range(1)
    n = lambda x: F.lit(x).cast("long")

    def of(outcome):
        return one.select(outcome).first()[0]

    assert of(coverage.board_outcome(n(3), n(2), n(2), F.lit(False))) == "partial" and of(coverage.board_outcome(n(3), n(2), n(2), F.lit(False), since="x")) == "success"
    assert of(coverage.board_outcome(n(None), n(2), n(2), F.lit(False))) == "success" and of(coverage.list_outcome(n(None), n(2), n(2))) == "failed"
    assert of(coverage.portal_outcome(n(2), n(2), n(None), n(5))) == "partial" and of(coverage.exit_code(F.lit("manual"))) == 3


def test_streams(record, spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "t")
    record({"source_id": "1", "crawled_at": "2026-07-10T00:00:00+09:00"}).write.mode("append").json(str(source))
    ingest.append(ingest.announcements(spark, str(source)), table, str(tmp_path / "c1")).awaitTermination()
    ingest.upsert(ingest.announcements(spark, str(source)), str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination()
    record({"source_id": "1", "title": "new"}, {"source_id": "2"}).write.mode("append").json(str(source))
    ingest.append(ingest.announcements(spark, str(source)), table, str(tmp_path / "c1")).awaitTermination()
    ingest.upsert(ingest.announcements(spark, str(source)), str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(table).count() == 3
    made = ingest.announcements(spark, str(source)).schema
    assert {r.source_id: r.title for r in ingest.current(spark, str(tmp_path / "u"), made).collect()} == {"1": "new", "2": "t"}
    record({"source_id": "3"}).write.mode("append").json(str(source))
    ingest.upsert(ingest.announcements(spark, str(source)), str(tmp_path / "u"), str(tmp_path / "c2")).awaitTermination()
    assert {r.source_id: r.title for r in ingest.current(spark, str(tmp_path / "u"), made).collect()} == {"1": "new", "2": "t", "3": "t"}
    assert len(list((tmp_path / "u/batch=2").glob("bucket=*"))) == 1 and ingest.current(spark, str(tmp_path / "u"), made, 1).count() == 1
    days = ingest.counts_by_day(ingest.announcements(spark, str(source)))
    assert days.isStreaming and "EventTimeWatermark" in days._jdf.queryExecution().analyzed().toString()


def test_first_and_withheld_pages_are_found_together(spark):
    pages = spark.createDataFrame([(3, "x"), (5, "captcha"), (4, "y"), (7, "captcha")], "page int, body string")
    kept, blocked, first = survey.html_pages(spark, pages)
    assert (sorted(r.page for r in kept.collect()), blocked, first) == ([3, 4], True, 3)
    assert survey.html_pages(spark, pages.where("page < 5"))[1:] == (False, 3) and survey.html_pages(spark, pages.where("page < 0"))[1:] == (False, None)


def test_tasks_of_a_batch_follow_its_rows(spark, tmp_path, monkeypatch):
    rows = [f'{{"source": "s", "source_id": "{i % 90}", "title": "t{i}", "crawled_at": "{i:03}"}}' for i in range(120)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join(rows))
    monkeypatch.setattr(ingest, "TASK_ROWS", 6)
    stream = ingest.announcements(spark, str(tmp_path / "in"))
    ingest.upsert(stream, str(tmp_path / "out"), str(tmp_path / "offsets"), 1).awaitTermination()
    assert len(list((tmp_path / "out").rglob("*.parquet"))) > 4
    got = {r.source_id: r.title for r in ingest.current(spark, str(tmp_path / "out"), stream.schema).collect()}
    assert got == {str(i % 90): f"t{i}" for i in range(120)}


def test_components(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9)] + [(100, i) for i in range(101, 130)] + [(i, i + 1) for i in range(200, 260)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got[3] == 1 and got[8] == 7 and 9 not in got and got[129] == 100 and got[260] == 200


def test_same_programmes(record):
    from noticeflow.operators.programmes import same_programmes

    rows = record(
        {"source": "a", "source_id": "1", "title": "제목 하나", "agency": "기관", "announce_no": "N-1", "canonical_url": "https://a/1"},
        {"source": "b", "source_id": "2", "title": "다른", "agency": "기관", "announce_no": "N-1", "canonical_url": "https://b/2"},
        {"source": "c", "source_id": "PBLN_7", "title": "x", "agency": "y"},
        {"source": "d", "source_id": "8", "title": "z", "canonical_url": "https://d/?pblancId=PBLN_7"},
        {"source": "e", "source_id": "9", "title": "t", "agency": "g", "apply_start": "2026-01-01", "apply_end": "2026-02-01"},
        {"source": "f", "source_id": "9", "title": " t ", "agency": "g", "apply_start": "2026-01-01", "apply_end": "2026-02-01", "announce_no": ""},
        {"source": "g", "source_id": "10", "title": "t", "agency": "g"},
    )
    groups = {}
    for r in same_programmes(rows).collect():
        groups.setdefault(r.programme, set()).add((r.source, r.size))
    assert sorted(map(sorted, groups.values())) == [[("a", 2), ("b", 2)], [("c", 2), ("d", 2)], [("e", 2), ("f", 2)], [("g", 1)]]


def test_processed_attachments(spark):
    from noticeflow.sources import attachments

    from .test_functions import hwpx

    base = "https://bizinfo.go.kr"
    links = spark.createDataFrame([("1", 0, f"{base}/a", "a.hwpx"), ("2", 0, f"{base}/a", "a.hwpx"), ("1", 1, f"{base}/uploads/b", "b"), ("1", 2, "https://evil.example/c", "c"), ("1", 3, f"{base}/d", "d"), ("1", 4, f"{base}/e", "e.xyz")], "source_id string, pos int, url string, filename string")
    files = spark.createDataFrame([(f"{base}/a", "/x/a.hwpx", 9, hwpx({0: "글"}), "h1"), (f"{base}/e", "/x/e.xyz", 1, b"e", "h2"), (f"{base}/d", "/x/d.pdf", attachments.MAX_FILE + 1, b"", "h3")], "url string, path string, length long, content binary, sha256 string")
    rows = attachments.processed(links, files, ["bizinfo.go.kr"], ["/upload"])
    got = {(r.source_id, r.pos): (r.attachment.download_status, r.attachment.extract_status, r.attachment.sha256) for r in rows.collect()}
    assert got == {("1", 0): ("ok", "ok", "h1"), ("2", 0): ("ok", "ok", "h1"), ("1", 1): ("skipped_robots", "skipped", None), ("1", 2): ("blocked_redirect", "skipped", None), ("1", 3): ("failed", "skipped", None), ("1", 4): ("ok", "unsupported", "h2")}


def test_command_line(spark, tmp_path):
    from noticeflow.__main__ import main

    from .test_functions import hwpx

    landed = land(tmp_path / "l", page1=envelope(1, notice(1)))
    assert main(["list", "pbanc", landed, "--out", str(tmp_path / "new"), "--as-of", "2026-07-10"], spark) == 0
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "s.jsonl").write_text("\n".join(p.read_text(encoding="utf-8") for p in (tmp_path / "new").glob("*.json")), encoding="utf-8")
    assert main(["diff", str(tmp_path / "a"), str(tmp_path / "b"), "--out", str(tmp_path / "d")], spark) == 0
    (tmp_path / "b/s.jsonl").write_text("", encoding="utf-8")
    assert main(["diff", str(tmp_path / "a"), str(tmp_path / "b"), "--out", str(tmp_path / "d2")], spark) == 1
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.hwpx").write_bytes(hwpx({0: "글"}))
    assert main(["extract", str(tmp_path / "f"), "--out", str(tmp_path / "x")], spark) == 0
    (tmp_path / "f/b.xyz").write_bytes(b"1")
    assert main(["extract", str(tmp_path / "f"), "--out", str(tmp_path / "y")], spark) == 2
    assert [r.text for r in spark.read.parquet(str(tmp_path / "y/texts")).collect()] == ["글"]


def test_groups_of_all_documents(spark, tmp_path):
    """Brute-force union-find over texts and first lines, long documents too."""
    import random

    from noticeflow import catalogue

    rng = random.Random(3)
    long = "word " * 300
    texts = [f"{rng.choice(['', ' ', 'title one', 'title  one', 'title two', 'other'])}\n{rng.choice(['', long, long + 'x'])}{rng.randrange(4)}" for _ in range(60)] + [long, long, None, None, "", " "]
    spark.createDataFrame([(i, t, "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    first = {}
    for i, t in enumerate(texts):
        for key in () if t is None else (("text", t), ("line", " ".join(t.split("\n")[0].split()))):
            if key != ("line", ""):
                a, b = root(i), root(first.setdefault(key, i))
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component for r in catalogue.same_program_groups(spark, str(tmp_path)).collect()}
    assert got == {i: root(i) for i in range(len(texts))}
    assert got[61] == 60


def test_details_of_all_orders(spark, sf):
    from noticeflow import catalogue

    lines = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_returnflag").collect()
    orders = {str(r.l_orderkey) for r in lines}
    failed = {str(r.l_orderkey) for r in lines if r.l_returnflag == "R"}
    assert {r.source_id: r.attachments_complete for r in catalogue.attachments_complete(spark, sf).collect()} == {k: k not in failed for k in orders}
    assert {r.source_id for r in catalogue.attachment_hash_sorted(spark, sf).collect()} == orders
    assert {r.source_id for r in catalogue.upsert_unmatched(spark, sf).collect()} == {k for k in orders if int(k) % 2}
    done = {str(r.o_orderkey) for r in spark.read.parquet(f"{sf}/orders.parquet").where("o_orderstatus <> 'P'").select("o_orderkey").collect()}
    assert {r.source_id for r in catalogue.detail_upsert(spark, sf).collect() if r.content_hash} == orders & done


def test_partial_screening_and_type_sections(spark):
    from noticeflow.operators import report

    counts = [("a", "success", "success", 5, 4, 1, 1), ("b", "success", "partial", 5, 4, 1, 1), ("c", "success", "success", 5, 5, 1, 1)]
    made = spark.createDataFrame(counts, "source string, collection_status string, screening_status string, collected long, screened long, candidate long, detail_verified long")
    assert [r.source for r in report.manifest_errors(made).collect()] == ["a"]
    want = [(t, v) for t in (*report.TYPES, None) for v in (*report.VERDICTS, None)]
    rows = spark.createDataFrame([("s", str(i), t, v) for i, (t, v) in enumerate(reversed(want))], "source string, source_id string, primary_type string, verdict string")
    assert [(r.primary_type, r.verdict) for r in report.ordered_by_type(rows).collect()] == want


def test_shared_folder(spark, tmp_path):
    from noticeflow import storage

    df = storage.materialise(spark.range(5), "x")
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert os.path.isdir(folder) and df.count() == 5
    storage.discard(df)
    assert not os.path.isdir(folder)
    outside = spark.range(3)
    outside.write.parquet(f"file://{tmp_path}/own")
    storage.discard(spark.read.parquet(f"file://{tmp_path}/own"))
    assert spark.read.parquet(f"file://{tmp_path}/own").count() == 3

    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return "spark://host:7077" if key == "spark.master" else default

    with pytest.raises(RuntimeError):
        storage.shared_dir(Cluster)


def test_order_of_the_report_by_type(spark):
    rows = [("s", str(i), t, v) for i, (t, v) in enumerate([("advisory", "확인됨"), ("grant", "신청 불가"), (None, "확인됨"), ("grant", "확인됨"), ("loan", "조건부"), ("grant", None)])]
    got = report.ordered_by_type(spark.createDataFrame(rows, "source string, source_id string, primary_type string, verdict string")).collect()
    assert [r.source_id for r in got] == ["3", "1", "5", "4", "0", "2"]


def test_details_on_the_command_line(spark, tmp_path):
    from noticeflow import __main__ as cli

    listing = tmp_path / "l"
    spark.createDataFrame([("PBLN_1", "x"), ("PBLN_2", "y")], "source_id string, title string").select(*listings.record(source="bizinfo", source_id=F.col("source_id"), title=F.col("title"))).write.json(f"file://{listing}")
    page = """<script>var altUrl = location.origin + location.pathname + "?pblancId={}";</script><div class="view_cont">본문</div>"""
    pages = land(tmp_path / "p", PBLN_1=page.format("PBLN_1"), PBLN_2=page.format("PBLN_9"))
    run = lambda source, folder, out: cli.main(["detail", source, f"file://{listing}", folder, "--out", f"file://{tmp_path}/{out}"], spark)
    assert run("bizinfo", pages, "o") == 2
    got = {r.source_id: r for r in spark.read.schema(schema.ANNOUNCEMENT).json(f"file://{tmp_path}/o").collect()}
    assert got["PBLN_1"].hash_version == 2 and got["PBLN_1"].content_hash and got["PBLN_2"].content_hash is None
    assert run("bizinfo", land(tmp_path / "q", PBLN_1="<p>로그인이 필요합니다"), "o2") == 3
    assert run("bizinfo", land(tmp_path / "r", PBLN_1=page.format("PBLN_1")), "o3") == 0


def test_both_modes_and_withheld_pages_on_the_command_line(spark, tmp_path):
    from noticeflow import __main__ as cli

    one, two = land(tmp_path / "a", page1=envelope(1, notice(1))), land(tmp_path / "b", page1=envelope(2, notice(2)))
    assert cli.main(["list", "all", one, two, "--out", f"file://{tmp_path}/o"], spark) == 2
    assert {(r.source, r.source_id) for r in spark.read.schema(schema.ANNOUNCEMENT).json(f"file://{tmp_path}/o").collect()} == {("sbiz24", "1"), ("sbiz24_combine", "2")}
    assert cli.main(["list", "seoulshinbo", land(tmp_path / "s", p1="captcha"), "--out", f"file://{tmp_path}/s1"], spark) == 3
