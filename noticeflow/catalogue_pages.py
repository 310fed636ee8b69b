"""Queries for listings, details and sinks: the driver's tables are written as the pages that a site would serve, read by the library, and compared in SQL.

Pages are built with plain expressions (JSON texts, HTML rows), PAGE rows each, so that a query shows the whole way from a landed page to an announcement.
"""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noticeflow import schema as S
from noticeflow.catalogue import AS_OF, as_of, order_listing, query, table
from noticeflow.functions import pages as P
from noticeflow.functions import text as X
from noticeflow.functions import urls as U
from noticeflow.operators import coverage, diff, report, upsert
from noticeflow.operators.programmes import same_programmes
from noticeflow.plans import survey
from noticeflow.sources import attachments, listings, sinks, snapshots
from noticeflow.storage import work_dir
from noticeflow.streaming import ingest

PAGE = 100
NOW = "2026-01-01T00:00:00+09:00"


def crawled() -> Column:
    return F.lit(NOW)


def s(c) -> Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


def text(*parts) -> Column:
    """Literals and columns, joined."""
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def paged(rows: DataFrame, number: str, item: Column, before: Column | str, after: str, by: str = "") -> DataFrame:
    """(page, body): items in order of their number, PAGE a page."""
    own = rows.select((F.floor(F.col(number) / PAGE) + 1).cast("int").alias("page"), F.struct(F.col(number).alias("k"), item.alias("item")).alias("x"))
    items = own.groupBy("page").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    return items.select("page", text(before, F.array_join("items", by), after).alias("body"))


def parsed(pages: DataFrame, schema: T.StructType) -> DataFrame:
    """Pages of JSON as the reader gives them."""
    return pages.select(F.from_json("body", schema).alias("j"), F.col("page").alias("__page")).select("j.*", "__page").withColumn("page", F.col("__page")).drop("__page")


def orders(spark, sf_dir) -> DataFrame:
    """k, day and the other fields of all orders, under short names."""
    date = F.col("o_orderdate").cast("date")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), date.alias("d"), F.date_format(date, "yyyy-MM-dd").alias("day"), F.date_format(F.date_add(date, 30), "yyyy-MM-dd").alias("late"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("c"))


ORDERS = "(select o_orderkey as k, cast(o_orderdate as date) as d, strftime(o_orderdate, '%Y-%m-%d') as day, strftime(o_orderdate + interval 30 day, '%Y-%m-%d') as late, o_orderstatus as status, o_orderpriority as priority, o_custkey as c from orders)"
OPEN_OR_CLOSED = f"case when {{0}} >= date '{AS_OF}' then '접수중' else '마감' end"
FLAT = ["source", "source_id", "announce_no", "canonical_url", "title", "agency", "region_scope", "apply_start", "apply_end", "status"]


def flat(rows: DataFrame, *raw: str) -> DataFrame:
    """Announcements without arrays and maps."""
    return rows.select("page", *FLAT, F.array_join("tags", "|").alias("tags"), F.size("attachments").alias("n_attachments"), "attachments_complete", "crawled_at", *(F.col("raw")[r].alias(f"raw_{r}") for r in raw), F.size("raw").alias("n_raw"))


REST = f"cast(0 as integer) as n_attachments, {{0}} as attachments_complete, '{NOW}' as crawled_at"

# ---------------------------------------------------------------- listings


def list_pages(spark, sf_dir, mode: str = "pbanc", total: Column | None = None) -> DataFrame:
    k, o = F.col("k"), orders(spark, sf_dir)
    code = F.element_at(F.array(*map(F.lit, ["Y", "N", "상시모집", "예산 소진시", "예정", ""])), (k % 6 + 1).cast("int"))
    item = {
        "pbancSn": s("k"), "pbancNm": text("order ", k), "rcptPd": F.struct(F.col("day").alias("from"), F.when(k % 3 == 0, "").otherwise(F.col("late")).alias("to")), "aplyPsbltySe": code,
        "regionNmList": F.when(k % 4 != 0, text("region ", k % 5)), "hstgNm": text("a, b,, c", k % 3), "pbancGubun": F.col("status"), "bizType": F.when(k % 2 == 0, "일반"),
    }
    if mode == "combine":
        item |= {"aplyPd": F.when(k % 7 != 0, text(" ", F.col("day"), " ~ ", F.col("late"))), "pbancId": F.when(k % 3 == 0, text("PBLN_", k)), "departNm": F.when(k % 4 == 0, text("office ", k % 9)), "rcrtTypeCdNm": F.when(k % 4 == 1, "type")}
    whole = F.lit(total if total is not None else 0)
    return parsed(paged(o, "k", F.to_json(F.struct(*(v.alias(n) for n, v in item.items()))), text('{"result":true,"data":{"default":{"total":', whole, ',"list":['), "]}}}", ","), S.LIST_PAGE)


LIST_STATUS = f"case k % 6 when 0 then '접수중' when 1 then '마감' when 2 then '상시' when 3 then '예산소진' when 4 then '회차예정' else case when k % 3 = 0 then '불명' else {OPEN_OR_CLOSED.format('d + 30')} end end"


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'sbiz24' as source, cast(k as varchar) as source_id, cast(null as varchar) as announce_no, 'https://www.sbiz24.kr/#/pbanc/' || k as canonical_url, 'order ' || k as title,
      '소상공인시장진흥공단' as agency, case when k % 4 = 0 then '전국' else 'region ' || (k % 5) end as region_scope, day as apply_start, case when k % 3 <> 0 then late end as apply_end, {LIST_STATUS} as status,
      'a|b|c' || (k % 3) as tags, {REST.format('false')}, status as raw_pbancGubun, cast(case when k % 2 = 0 then 2 else 1 end as integer) as n_raw from {ORDERS}
""")
def sbiz_list(spark, sf_dir):
    return flat(listings.sbiz_notices(list_pages(spark, sf_dir), "pbanc", as_of(), crawled()), "pbancGubun")


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'sbiz24_combine' as source, n as source_id, case when k % 3 = 0 then n end as announce_no,
      'https://www.sbiz24.kr/#/' || case when k % 3 = 0 then 'extldPbanc/' else 'pbanc/' end || n as canonical_url, 'order ' || k as title, case k % 4 when 0 then 'office ' || (k % 9) when 1 then 'type' else '미상' end as agency,
      case when k % 4 = 0 then '전국' else 'region ' || (k % 5) end as region_scope, case when k % 7 <> 0 then day end as apply_start, case when k % 7 <> 0 then late end as apply_end,
      case when k % 6 = 5 and k % 3 = 0 then case when k % 7 = 0 then '불명' else {OPEN_OR_CLOSED.format('d + 30')} end else {LIST_STATUS} end as status, 'a|b|c' || (k % 3) as tags, {REST.format('false')}, status as raw_pbancGubun,
      cast(1 + cast(k % 2 = 0 as integer) + cast(k % 4 = 1 as integer) as integer) as n_raw from (select *, case when k % 3 = 0 then 'PBLN_' || k else cast(k as varchar) end as n from {ORDERS})
""")
def sbiz_combined_list(spark, sf_dir):
    return flat(listings.sbiz_notices(list_pages(spark, sf_dir, "combine"), "combine", as_of(), crawled()), "pbancGubun")


def portal_pages(spark, sf_dir, more: Column | None = None, shown: int = 0) -> DataFrame:
    """The portal's table; rows of every fifth order end after the period. ``more`` follows the table, and each page repeats the last ``shown`` rows of the one before."""
    k, o = F.col("k"), orders(spark, sf_dir)
    period = F.when(k % 3 == 0, "예산 소진시까지").otherwise(text(F.date_format("d", "yyyy.MM.dd"), " ~ ", F.date_format(F.date_add("d", 30), "yyyy-M-d")))
    rest = F.when(k % 5 == 0, "").otherwise(text("<td> 부처 ", k % 9, "</td><td>", F.when(k % 2 == 0, "").otherwise(text("기관", k % 2)), "</td><td>", F.col("day"), "</td><td>9</td>"))
    row = text("<tr>\n<td>", k, "</td><td>field&amp;", k % 4, '</td><td class="t"><a title="x" href = "/v.do?pblancId=PBLN_', k, '&amp;m=1" class="l">\n order  &lt;', k, "&gt; </a></td><td>\n", period, "\n</td>", rest, "</tr>")
    return paged(o, "k", row, "<table><tr><th>no</th></tr><tr><td>no link</td></tr>", "</table>")


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'bizinfo' as source, 'PBLN_' || k as source_id, 'PBLN_' || k as announce_no, 'https://www.bizinfo.go.kr/sii/siia/selectSIIA200Detail.do?pblancId=PBLN_' || k as canonical_url, 'order <' || k || '>' as title,
      case when k % 5 = 0 then '' when k % 2 = 0 then '부처 ' || (k % 9) else '부처 ' || (k % 9) || ' / 기관1' end as agency, cast(null as varchar) as region_scope, case when k % 3 <> 0 then day end as apply_start,
      case when k % 3 = 0 then '예산 소진시까지' else late end as apply_end, case when k % 3 = 0 then '불명' else {OPEN_OR_CLOSED.format('d + 30')} end as status, 'field&' || (k % 4) as tags, {REST.format('false')},
      'field&' || (k % 4) as raw_field, case when k % 5 = 0 then '' else day end as raw_reg_date, cast(2 as integer) as n_raw from {ORDERS}
""")
def portal_list(spark, sf_dir):
    return flat(listings.bizinfo_notices(portal_pages(spark, sf_dir), as_of(), crawled()), "field", "reg_date")


def year_pages(spark, sf_dir) -> DataFrame:
    k, o = F.col("k"), orders(spark, sf_dir)
    item = {
        "sprtBizCd": F.when(k % 10 != 0, s("k")), "sprtBizNm": text(" order&nbsp;", k), "sprtBizCtpvNm": F.when(k % 4 != 0, text("region ", k % 5)), "rcritBgngYmd": F.col("day"),
        "rcritEndYmd": F.when(k % 3 != 0, F.col("late")), "sprtBizTyNm": F.when(k % 2 == 0, "유형"), "sprtBizTrgtNm": F.lit("all"), "sprtBizYr": F.date_format("d", "yyyy"),
    }
    return parsed(paged(o, "k", F.to_json(F.struct(*(v.alias(n) for n, v in item.items()))), '{"years":["2001"],"list":[', "]}", ","), S.YEAR_PAGE)


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'fanfandaero' as source, 'biz-' || k as source_id, 'biz-' || k as announce_no, 'https://fanfandaero.kr/portal/v2/preSprtBizPbancDetail.do?sprtBizCd=' || k as canonical_url, 'order ' || k as title,
      '중소기업유통센터(판판대로)' as agency, case when k % 4 <> 0 then 'region ' || (k % 5) end as region_scope, day as apply_start, case when k % 3 <> 0 then late end as apply_end,
      case when k % 3 = 0 then '불명' else {OPEN_OR_CLOSED.format('d + 30')} end as status, case when k % 2 = 0 then '유형' else '' end as tags, {REST.format('false')}, 'all' as raw_target, strftime(d, '%Y') as raw_biz_year, cast(2 as integer) as n_raw
    from {ORDERS} where k % 10 <> 0
""")
def yearly_programmes(spark, sf_dir):
    return flat(listings.fanfan_notices(year_pages(spark, sf_dir), as_of(), crawled()), "target", "biz_year")


def events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("k"), F.col("ts").cast("date").alias("d"), F.col("event_type").alias("kind"), F.date_format("ts", "yyyy-MM-dd").alias("day"))


EVENTS = "(select event_id as k, cast(ts as date) as d, event_type as kind, strftime(ts, '%Y-%m-%d') as day from events)"


def board_pages(spark, sf_dir, before: Column | str = "<ul>") -> DataFrame:
    k = F.col("k")
    post = text("<li><a href=\"#\" onclick=\"detailPage('", k, '\');" class="title"> ', F.col("kind"), "<b></b> &amp; ", k, '</a>\n<em>x</em><span class="date">', F.date_format("d", "yyyy.MM.dd"), "</span></li>")
    return paged(events(spark, sf_dir), "k", post, before, "</ul>")


BOARD_REST = f"cast(null as varchar) as apply_start, cast(null as varchar) as apply_end, '불명' as status, '' as tags, {REST.format('false')}"


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'fanfandaero' as source, 'ntc-' || k as source_id, 'ntc-' || k as announce_no, 'https://fanfandaero.kr/portal/v2/readUcenterNtcBbsView.do?nttId=' || k as canonical_url, kind || '<b></b> & ' || k as title,
      '중소기업유통센터(판판대로)' as agency, cast(null as varchar) as region_scope, {BOARD_REST}, day as raw_posted, '공지사항' as raw_board, cast(2 as integer) as n_raw from {EVENTS}
""")
def board_posts(spark, sf_dir):
    return flat(listings.fanfan_board(board_pages(spark, sf_dir), crawled()), "posted", "board")


def doubled_pages(spark, sf_dir, keep: Column | None = None) -> DataFrame:
    """A board whose markup holds every post twice, with different titles."""
    k, rows = F.col("k"), events(spark, sf_dir)
    line = lambda title: text("<tr><td class=\"title\"><a href=\"#\" onclick=\"goView('1', '", k, "')\"><span class=\"ellipsis\">", title, " ", k, "</span></a></td><td>", F.when(k % 3 == 0, "").otherwise(F.col("kind")), "</td><td>", F.date_format("d", "yyyy.M.d"), "</td></tr>")
    return paged(rows if keep is None else rows.where(keep), "k", F.concat(line("first"), line("second")), "<table>", "</table>")


@query(f"""
    select cast(k // {PAGE} + 1 as integer) as page, 'seoulshinbo' as source, 'ntc-' || k as source_id, 'ntc-' || k as announce_no, 'https://www.seoulshinbo.co.kr/wbase/contents/bbs/view/' || k || '.do?mng_cd=STRY9788&pageIndex=1' as canonical_url,
      'first ' || k as title, case when k % 3 = 0 then '서울신용보증재단' else '서울신용보증재단/' || kind end as agency, '서울' as region_scope, {BOARD_REST}, day as raw_posted, '공지사항(STRY9788)' as raw_board, cast(2 as integer) as n_raw from {EVENTS}
""")
def doubled_board(spark, sf_dir):
    return flat(listings.ssb_board(doubled_pages(spark, sf_dir), crawled()), "posted", "board")


def api_pages(spark, sf_dir, total: int | None = None) -> DataFrame:
    """Parts as services; the id's name differs, some have none, and some no title."""
    k = F.col("p_partkey")
    number = F.when(k % 11 == 0, F.create_map(F.lit("other"), s(k))).when(k % 3 == 0, F.create_map(F.lit("서비스ID"), text("S", k))).when(k % 3 == 1, F.create_map(F.lit("SVC_ID"), text(" S", k))).otherwise(F.create_map(F.lit("serviceId"), text("S", k)))
    deadline = F.element_at(F.array(F.lit("상시신청"), F.lit("예산에 따름"), F.lit("2001년 2월 3일까지"), F.lit("1995.1.2 마감"), F.lit("")), (k % 5 + 1).cast("int"))
    own = {"서비스명": F.when(k % 13 != 0, F.col("p_name")), "신청기한": deadline, "소관기관명": F.col("p_brand"), "부서명": F.when(k % 2 == 0, F.col("p_type")), "지원유형": text("t", k % 4), "지원대상": F.when(k % 4 == 0, "소상공인"), "서비스목적": F.lit("p"), "상세조회URL": F.when(k % 6 == 0, text("https://x/", k))}
    item = F.to_json(F.map_concat(number, F.map_filter(F.create_map(*(x for n, v in own.items() for x in (F.lit(n), v))), lambda _, v: v.isNotNull())))
    parts = table(spark, sf_dir, "part")
    return parsed(paged(parts, "p_partkey", item, f'{{"page":1,"perPage":{PAGE},"totalCount":{"null" if total is None else total},"data":[', "]}", ","), S.API_PAGE)


API_STATUS = "case p_partkey % 5 when 0 then '상시' when 2 then '접수중' when 3 then '마감' else '불명' end"
API_WHERE = "p_partkey % 11 <> 0 and p_partkey % 13 <> 0"


@query(f"""
    select cast(p_partkey // {PAGE} + 1 as integer) as page, 'gov24' as source, 'S' || p_partkey as source_id, 'S' || p_partkey as announce_no, case when p_partkey % 6 = 0 then 'https://x/' || p_partkey else 'https://www.gov.kr/portal/rcvfvrSvc/dtlEx/S' || p_partkey end as canonical_url,
      trim(p_name) as title, trim(p_brand) || case when p_partkey % 2 = 0 then ' / ' || trim(p_type) else '' end as agency, cast(null as varchar) as region_scope, cast(null as varchar) as apply_start,
      case p_partkey % 5 when 2 then '2001-02-03' when 3 then '1995-01-02' end as apply_end, {API_STATUS} as status, 't' || (p_partkey % 4) as tags, {REST.format('true')}, 'p' as raw_purpose,
      cast(4 + cast(p_partkey % 5 <> 4 as integer) + cast(p_partkey % 2 = 0 as integer) + cast(p_partkey % 4 = 0 as integer) + cast(p_partkey % 6 = 0 as integer) as integer) as n_raw
    from part where {API_WHERE}
""")
def api_services(spark, sf_dir):
    return flat(listings.gov24_services(api_pages(spark, sf_dir), as_of(), crawled()), "purpose")


@query(f"select 'S' || p_partkey as source_id from part where {API_WHERE} and p_partkey % 4 = 0")
def api_needle(spark, sf_dir):
    return listings.gov24_services(api_pages(spark, sf_dir), as_of(), crawled(), "소상공인 p").select("source_id")


# ---------------------------------------------------------------- coverage of whole plans


def cover(listing: survey.Listing) -> DataFrame:
    return listing.coverage


@query(f"""
    select 'pbanc' as source, n as total, n as fetched, n as collected, cast(0 as bigint) as duplicates, 'success' as outcome, cast(0 as integer) as exit_code from (select count(*) as n from orders)
    union all select 'combine', n + 1, n, n, 0, 'partial', 2 from (select count(*) as n from orders)
""")
def both_modes_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "orders").count()
    return cover(survey.sbiz_all(spark, list_pages(spark, sf_dir, "pbanc", n), list_pages(spark, sf_dir, "combine", n + 1), as_of(), crawled()))


@query("""select 'sbiz24' as source, count(*) as n from orders union all select 'sbiz24_combine', count(*) from orders""")
def both_modes_rows(spark, sf_dir):
    rows = survey.sbiz_all(spark, list_pages(spark, sf_dir, "pbanc", 9), list_pages(spark, sf_dir, "combine", 9), as_of(), crawled()).rows
    return rows.groupBy("source").agg(F.count("*").alias("n"))


@query("""select 'partial' as outcome, cast(2 as integer) as exit_code""")
def both_modes_outcome(spark, sf_dir):
    return coverage.worst(both_modes_coverage(spark, sf_dir))


@query(f"""select 'pbanc' as source, cast(999999 as bigint) as total, count(*) as fetched, count(*) as collected, cast(0 as bigint) as duplicates, 'success' as outcome, cast(0 as integer) as exit_code from orders where o_orderkey // {PAGE} + 1 <= 3""")
def capped_coverage(spark, sf_dir):
    return cover(survey.sbiz(spark, list_pages(spark, sf_dir, "pbanc", 999999), "pbanc", as_of(), crawled(), max_pages=3))


def counted_portal(spark, sf_dir, extra: int = 0) -> DataFrame:
    last, n = table(spark, sf_dir, "orders").agg((F.floor(F.max("o_orderkey") / PAGE) + 1).cast("int"), F.count("*")).first()
    pages = portal_pages(spark, sf_dir)
    return pages.select("page", text("body", f'<a title="전체 분야({n + extra:,}) 공고보기" href="#" id="hashAll">', F.col("body"), f'<a href="?cpage=1"></a><a href="?cpage={last}"></a>').alias("body"))


@query(f"""
    select 'bizinfo' as source, last as expected_pages, last as pages, n + e as expected, n as collected, case when e = 0 then 'success' else 'partial' end as outcome, cast(case when e = 0 then 0 else 2 end as integer) as exit_code
    from (select max(o_orderkey) // {PAGE} + 1 as last, count(*) as n from orders), (values (0), (1)) v(e)
""")
def portal_coverage(spark, sf_dir):
    made = [cover(survey.bizinfo(spark, counted_portal(spark, sf_dir, extra), as_of(), crawled())) for extra in (0, 1)]
    return made[0].unionByName(made[1])


@query(f"""select 'PBLN_' || o_orderkey as source_id, 'again' as title, cast(o_orderkey // {PAGE} + 1 as integer) as page from orders where o_orderkey // {PAGE} = 0
    union all select 'PBLN_' || o_orderkey, 'order <' || o_orderkey || '>', cast(o_orderkey // {PAGE} + 1 as integer) from orders where o_orderkey // {PAGE} between 1 and 2""")
def portal_stops_without_new_rows(spark, sf_dir):
    """Page 4 repeats page 1 under other titles, so it has no new row: it counts, its values win, and pages after it don't."""
    pages = counted_portal(spark, sf_dir)
    again = pages.where("page = 1").select(F.lit(4).alias("page"), F.regexp_replace("body", "order  &lt;[0-9]+&gt;", "again").alias("body"))
    rows = survey.bizinfo(spark, pages.where("page <> 4").unionByName(again), as_of(), crawled()).rows
    return rows.select("source_id", "title", "page")


@query(f"""
    select 'fanfandaero' as source, n as total, n as collected, cast({PAGE} as bigint) as first_rows, 'success' as outcome, cast(0 as integer) as exit_code from (select count(*) as n from events)
    union all select 'fanfandaero', n + 1, n, {PAGE}, 'partial', 2 from (select count(*) as n from events)
""")
def board_coverage(spark, sf_dir):
    n = table(spark, sf_dir, "events").count()
    made = [cover(survey.fanfan(spark, year_pages(spark, sf_dir), board_pages(spark, sf_dir, f'<p>var totalRecordCount = "{total}";</p>'), as_of(), crawled())) for total in (n, n + 1)]
    return made[0].unionByName(made[1])


@query(f"""
    select 'seoulshinbo' as source, thin, f as first_rows, n as collected, case when thin > 0 then 'partial' else 'success' end as outcome, cast(case when thin > 0 then 2 else 0 end as integer) as exit_code from (
      select cast(count(*) filter (where c < {PAGE} / 2 and page < last) as bigint) as thin, cast(sum(c) as bigint) as n, max(c) filter (where page = 1) as f from (select *, max(page) over () as last from (select k // {PAGE} + 1 as page, count(*) as c from {EVENTS} where k // {PAGE} % 3 <> 1 or k % {PAGE} < 30 group by 1)))
""")
def thin_page_coverage(spark, sf_dir):
    """Every third page has 30 posts of 100; the last page is one of those that may be short."""
    k = F.col("k")
    return cover(survey.ssb(spark, doubled_pages(spark, sf_dir, (F.floor(k / PAGE) % 3 != 1) | (k % PAGE < 30)), crawled(), expected=PAGE))


@query(f"""
    select 'gov24' as source, t as total, n as fetched, m as collected, f as first_rows, true as known, case when t > n or m < t then 'partial' else 'success' end as outcome, cast(case when t > n or m < t then 2 else 0 end as integer) as exit_code
    from (select count(*) as n, count(*) filter (where {API_WHERE}) as m, count(*) filter (where p_partkey // {PAGE} = 0) as f from part), (select count(*) filter (where {API_WHERE}) as t from part union all select count(*) + 1 from part)
""")
def api_coverage(spark, sf_dir):
    """The announced total is first that of services with id and title, then more than there are rows; the first row of the first page has an id."""
    keep = (F.col("p_partkey") % 11 != 0) & (F.col("p_partkey") % 13 != 0)
    n, m = table(spark, sf_dir, "part").agg(F.count("*"), F.count_if(keep)).first()
    made = [cover(survey.gov24(spark, first_known(api_pages(spark, sf_dir, total)), as_of(), crawled())) for total in (m, n + 1)]
    return made[0].unionByName(made[1])


def first_known(pages: DataFrame) -> DataFrame:
    """Rows of a page with those first that have an id and a title."""
    named = F.transform("data", lambda x: F.struct((X.first_filled(*(x[i] for i in listings.ID_KEYS)).isNull() | x["서비스명"].isNull()).alias("last"), F.monotonically_increasing_id().alias("z"), x.alias("x")))
    return pages.withColumn("data", F.transform(F.concat(F.filter(named, lambda y: ~y["last"]), F.filter(named, lambda y: y["last"])), lambda y: y["x"]))


@query("""select 'inactive' as outcome, cast(4 as integer) as exit_code""")
def api_without_answers(spark, sf_dir):
    return cover(survey.gov24(spark, api_pages(spark, sf_dir).where("page < 0"), as_of(), crawled())).select("outcome", "exit_code")


@query(f"""
    select 'manual' as outcome, cast(3 as integer) as exit_code, count(*) as collected from events where event_id // {PAGE} + 1 < 3
""")
def withheld_page(spark, sf_dir):
    """The third page asks for a login: what came before stays, nothing after it counts, and the outcome asks for a look by hand."""
    body = F.when(F.col("page") == 3, text("<html>로그인이 필요합니다", F.col("body"))).otherwise(F.col("body"))
    return cover(survey.ssb(spark, doubled_pages(spark, sf_dir).withColumn("body", body), crawled())).select("outcome", "exit_code", "collected")


@query("""select page_id, page_id % 4 in (1, 2, 3) as blocked from pages""")
def blocked_pages(spark, sf_dir):
    k = F.col("page_id") % 4
    mark = F.when(k == 1, "<p>CAPTCHA</p>").when(k == 2, "비정상적인 접근").when(k == 3, "접근이 차단되었습니다").otherwise("")
    late = F.concat(F.rpad(F.lit(""), 4000, "-"), F.lit("captcha"))  # too late in the page to count
    return table(spark, sf_dir, "pages").select("page_id", X.blocked_page(F.concat(mark, F.col("html"), late)).alias("blocked"))


@query("""
    select page_id, 1000 + page_id as total, cast(page_id % 90 + 5 as integer) as last, cast(case when page_id % 2 = 0 then page_id end as bigint) as board_total from pages
""")
def page_counts(spark, sf_dir):
    k = F.col("page_id")
    n = F.format_number(k + 1000, 0)
    tab = F.when(k % 3 == 0, text('<a title="전체 분야(', n, ') 공고보기" class="c" id="hashAll">')).when(k % 3 == 1, text('<a id="hashAll" title="전체 분야(', n, ')">')).otherwise(text('<a title="분야(7) 공고보기"><a title="분야(', n, ') 공고보기">'))
    body = text(F.col("html"), tab, '<a href="?cpage=2"><a href="?cpage=', k % 90 + 5, '"><a href="?cpage=3">', F.when(k % 2 == 0, text('<script>var totalRecordCount = "', k, '";</script>')).otherwise(""))
    return table(spark, sf_dir, "pages").select("page_id", body.alias("body")).select("page_id", P.announced_total(F.col("body")).alias("total"), P.last_page(F.col("body")).alias("last"), P.board_total(F.col("body")).alias("board_total"))


# ---------------------------------------------------------------- details


def answers(spark, sf_dir) -> DataFrame:
    k = F.col("k")
    item = F.struct(s(k).alias("pbancSn"), text("order ", k).alias("pbancNm"), text("<p>Order&nbsp;", k, "</p>\n<b>&lt;", F.col("priority"), "&gt;</b>").alias("pbancDtlCn"), F.struct(F.col("day").alias("from"), F.lit("").alias("to")).alias("rcptPd"), F.col("status").alias("pbancSttsCd"))
    return orders(spark, sf_dir).select("k", F.from_json(F.to_json(F.struct(F.lit(True).alias("result"), F.struct(item.alias("default")).alias("data"))), S.DETAIL).alias("j")).select("k", "j.*")


@query(f"""select cast(k as varchar) as source_id, 'order ' || k as title, 'Order ' || k || ' <' || priority || '>' as body_text, day as apply_start, cast(null as varchar) as apply_end, status as status_code from {ORDERS}""")
def detail_answers(spark, sf_dir):
    return listings.sbiz_detail(answers(spark, sf_dir))


@query("""
    select cast(l_orderkey as varchar) as pbanc_sn, l_partkey || '/' || l_linenumber as file_id, case when l_returnflag = 'A' then '' else l_returnflag || '.pdf' end as filename, cast(l_linenumber as bigint) as size,
      'https://www.sbiz24.kr/api/cmmn/file/' || l_partkey || '/' || l_linenumber as url from lineitem where l_linenumber <> 3
""")
def detail_files(spark, sf_dir):
    """Lines as files of their order; the third line has no id and so isn't a file."""
    one = F.struct(F.when(F.col("l_linenumber") != 3, text(F.col("l_partkey"), "/", F.col("l_linenumber"))).otherwise("").alias("fileId"), F.when(F.col("l_returnflag") != "A", text(F.col("l_returnflag"), ".pdf")).alias("fileNm"), F.col("l_linenumber").cast("long").alias("fileSz"))
    files = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(one).alias("list"))
    pages = files.select("l_orderkey", F.from_json(F.to_json(F.struct(F.lit(True).alias("result"), F.struct(F.struct("list").alias("default")).alias("data"))), S.FILES).alias("j")).select("l_orderkey", "j.*")
    return listings.sbiz_files(pages, "l_orderkey").select("pbanc_sn", "file_id", "filename", "size", "url")


@query(f"""
    select source_id, accepted, n_links, url, filename, complete, version, sha256(body) as content_hash from (
      select 'PBLN_' || k as source_id, k % 4 not in (1, 2) as accepted, cast(k % 3 as integer) as n_links, case when k % 3 > 0 then 'https://www.bizinfo.go.kr/cmm/fms/getFile.do?a=' || k || '&b=1' end as url, case when k % 3 > 0 then 'getFile.do' end as filename,
        k % 3 = 0 as complete, cast(2 as integer) as version, chr(10) || 'order ' || k || ' & more' || chr(10) || case when k % 3 > 0 then 'file' || chr(10) else '' end || case when k % 3 > 1 then 'other' || chr(10) else '' end as body from {ORDERS})
""")
def portal_detail_pages(spark, sf_dir):
    """Some pages say that they are another announcement, or two; ids in comments and strings don't count."""
    k = F.col("k")
    own = lambda n: text('<script>/* var altUrl = "no"; */ var altUrl = location.origin + location.pathname + "?pblancId=PBLN_', n, '";</script>')
    scripts = F.when(k % 4 == 1, own(k + 1)).when(k % 4 == 2, F.concat(own(k), own(k + 1))).otherwise(own(k))
    links = text(F.when(k % 3 > 0, text('<a href="/cmm/fms/getFile.do?a=', k, '&amp;b=1">file</a>')).otherwise(""), F.when(k % 3 > 1, '<a href="/uploads/x/other.pdf?v=1">other</a>').otherwise(""))
    body = text("<html><p>menu</p>", scripts, '<div class="a view_cont b"><style>p{}</style><p>order ', k, " &amp; more</p>\n \n", links, '<div class="btn_area">list</div><footer>f</footer>')
    found = survey.portal_details(orders(spark, sf_dir).select(text("PBLN_", k).alias("source_id"), body.alias("body")))
    return found.select("source_id", "accepted", F.size("links").alias("n_links"), F.get("links", F.lit(0))["url"].alias("url"), F.get("links", F.lit(0))["filename"].alias("filename"), F.col("attachments_complete").alias("complete"), F.col("hash_version").alias("version"), "content_hash")


def board_detail(found: DataFrame) -> DataFrame:
    return found.select("source", "source_id", "accepted", F.col("text").alias("body"), F.array_join(F.transform("links", lambda x: F.concat(x["url"], F.lit(" "), x["filename"])), "|").alias("links"))


@query(f"""
    select 'fanfandaero' as source, 'ntc-0' || k as source_id, k % 4 <> 1 as accepted, '본문 ' || k || chr(10) || kind || chr(10) || '9' as body,
      case when k % 2 = 0 then 'https://fanfandaero.kr/download.do?fileName=f/' || k || '.pdf name & ' || k else 'https://fanfandaero.kr/download.do?fileName=f/' || k || '.pdf ' || k || '.pdf' end as links from {EVENTS}
""")
def board_detail_pages(spark, sf_dir):
    """Labels and view counts go from the head of a body, a link that occurs twice counts once, and a viewer's call names it."""
    k = F.col("k")
    link = text('<a href="https://fanfandaero.kr/download.do?fileName=f/', k, '.pdf">')
    call = F.when(k % 2 == 0, text('<a onclick="view("fileName=f/', k, '.pdf&x=1", "1", " name &amp;  ', k, '")">')).otherwise("")
    body = text("<script>let nttId = '", F.when(k % 4 == 1, k + 1).otherwise(k), "';</script><p>menu</p>", '<div class="x contents">조회<br>12<br>등록일<br>본문 ', k, "<br>34<br>", F.col("kind"), "<br>9", link, link, call, '<div id="footer">f')
    return board_detail(survey.board_details(events(spark, sf_dir).select(text("ntc-0", k).alias("source_id"), body.alias("body")), "fanfandaero"))


@query(f"""
    select 'seoulshinbo' as source, 'ntc-' || k as source_id, k % 5 <> 2 as accepted, '본문 ' || k || chr(10) || case when k % 2 = 0 then 'a+b ' || k || '.pdf' else ' 공고.hwp' end as body,
      'https://www.seoulshinbo.co.kr/download/' || k || '/ab-' || lower(to_hex(k + 16)) || '.do?mng_cd=STRY9788 ' || case when k % 2 = 0 then 'a b ' || k || '.pdf' else '공고.hwp' end as links from {EVENTS}
""")
def doubled_board_detail_pages(spark, sf_dir):
    k = F.col("k")
    serial = text("ab-", F.lower(F.hex(k + 16)))
    name = F.when(k % 2 == 0, text("<span>a+b ", k, ".pdf</span>")).otherwise('<img src="i" alt=""> 공고.hwp')
    canonical = F.when(k % 5 == 2, text('<link rel="canonical" href="/bbs/view/', k + 1, '.do">')).otherwise(text('<link rel="canonical" href="/bbs/view/0', k, '.do">'))
    body = text(canonical, '<div class="sub_cont_wrap"><p>작성일</p>본문 ', k, "<br><a href=\"#\" onclick=\"common.download( 7 , '", serial, "')\" class=\"b\">", name, "</a>다음글 x")
    return board_detail(survey.board_details(events(spark, sf_dir).select(text("ntc-", k).alias("source_id"), body.alias("body")), "seoulshinbo"))


@query("""
    select 'S' || p_partkey as source_id, p_partkey % 3 <> 0 as matched, cast(3 as integer) as n_raw,
      sha256('{"content": null, "criteria": null, "deadline": null, "dept": null, "docs": null, "field": null, "how": null, "org": "' || p_brand || '", "purpose": null, "recv_org": null, "target": null, "tel": null, "title": "\\"' || p_name
        || '\\"", "type": null, "updated": null, "url": "https://x/' || p_partkey || '", "user_type": null}') as content_hash from part
""")
def api_details(spark, sf_dir):
    k = F.col("p_partkey")
    item = F.create_map(F.lit("SVC_ID"), text("S", F.when(k % 3 == 0, k + 1).otherwise(k)), F.lit("서비스명"), text('"', F.col("p_name"), '"'), F.lit("소관기관명"), F.col("p_brand"), F.lit("상세조회URL"), text("https://x/", k))
    found = listings.gov24_details(table(spark, sf_dir, "part").select(text("S", k).alias("asked"), F.array(item).alias("data")), "asked")
    return found.select("source_id", "matched", F.size("raw").alias("n_raw"), "content_hash")


@query(f"""
    select cast(k as varchar) as source_id, case when k % 10 = 9 then 'no listing row' when status <> 'A' and status <> 'D' then 'namespace without details' when k % 7 = 0 then 'contradictory kind' when k % 5 = 0 then 'answer of another id'
      when k % 4 = 0 then 'answer of another title' end as refused from (select k, case k % 3 when 0 then 'A' when 1 then 'D' else 'E' end as status from {ORDERS})
""")
def refused_details(spark, sf_dir):
    k, o = F.col("k"), orders(spark, sf_dir)
    space = F.when(k % 3 == 0, "A").when(k % 3 == 1, "D").otherwise("E")
    raw = F.map_filter(F.create_map(F.lit("pbancGubun"), space, F.lit("bizType"), F.when(k % 7 == 0, "대출상품")), lambda _, v: v.isNotNull())
    listing = o.where("k % 10 <> 9").select(*listings.record(source="sbiz24_combine", source_id=s(k), title=text("order &#40;", k, "&#41;"), raw=raw))
    got = o.select(s(k).alias("source_id"), F.when(k % 5 == 0, s(k + 1)).otherwise(s(k)).alias("returned_id"), F.when(k % 4 == 0, "other").otherwise(text(" order  (", k, ")")).alias("title"))
    return upsert.accepted_details(listing, o.select(s(k).alias("source_id")), got)


@query("""select 's' as source, '7' as source_id, 'order 7' as title from orders where o_orderkey = 7""")
def point_lookup(spark, sf_dir):
    return upsert.lookup(order_listing(spark, sf_dir).withColumn("source", F.lit("s")), "s", "7").select("source", "source_id", "title")


@query(f"""
    select source, cast(k as varchar) as source_id, case when k % 5 = 0 then h0 when k % 4 <> 0 then 'h' end as content_hash, cast(case when k % 5 = 0 or source = 'gov24' then 1 when source in ('fanfandaero', 'seoulshinbo') then v when k % 4 <> 0 then v end as integer) as hash_version,
      k % 5 <> 0 as attachments_complete from (select k, case when k % 3 = 0 then 3 else 2 end as v, 'old' as h0, case k % 6 when 0 then 'sbiz24' when 1 then 'sbiz24_combine' when 2 then 'bizinfo' when 3 then 'fanfandaero' when 4 then 'seoulshinbo' else 'gov24' end as source from {ORDERS})
""")
def version_rules(spark, sf_dir):
    """Details of all six sources: what a merge does to the version, with and without a hash; every fifth order has no detail."""
    k, o = F.col("k"), orders(spark, sf_dir)
    source = F.element_at(F.array(*map(F.lit, ["sbiz24", "sbiz24_combine", "bizinfo", "fanfandaero", "seoulshinbo", "gov24"])), (k % 6 + 1).cast("int"))
    listing = o.select(*listings.record(source=source, source_id=s(k), content_hash="old", hash_version=F.lit(1)))
    details = o.where("k % 5 <> 0").select(source.alias("source"), s(k).alias("source_id"), F.when(k % 4 != 0, "h").alias("content_hash"), F.when(k % 3 == 0, 3).alias("hash_version"), F.lit(True).alias("attachments_complete"))
    return upsert.upsert(listing, details).select("source", "source_id", "content_hash", "hash_version", "attachments_complete")


@query(f"""
    select cast(k as varchar) as source_id, case when k % 3 = 0 then 'loan' when k % 3 = 1 then 'old' else 'old' end as primary_type, case when k % 3 = 0 then k || '%' end as loan_rate, status as gubun from {ORDERS}
""")
def enriched_types(spark, sf_dir):
    k = F.col("k")
    listing = order_listing(spark, sf_dir).withColumn("primary_type", F.lit("old"))
    judged = orders(spark, sf_dir).where("k % 3 < 2").select(F.col("priority").alias("source"), s(k).alias("source_id"), F.when(k % 3 == 0, "loan").alias("primary_type"), F.when(k % 3 == 0, F.create_map(F.lit("loan_rate"), text(k, "%"))).alias("raw"))
    return upsert.enriched(listing, judged).select("source_id", "primary_type", F.col("raw")["loan_rate"].alias("loan_rate"), F.col("raw")["pbancGubun"].alias("gubun"))


@query("""
    select cast(l_orderkey as varchar) as source_id, sha256('body' || chr(10) || array_to_string(list_sort(list('h' || l_partkey) filter (where l_returnflag <> 'R')), chr(10))) as content_hash, bool_and(l_returnflag <> 'R') as complete,
      array_to_string(list('f' || l_partkey order by l_linenumber, l_partkey, l_returnflag), ',') as names from lineitem group by l_orderkey having bool_and(l_returnflag <> 'R')
    union all select cast(l_orderkey as varchar), null, false, array_to_string(list('f' || l_partkey order by l_linenumber, l_partkey, l_returnflag), ',') from lineitem group by l_orderkey having not bool_and(l_returnflag <> 'R')
""")
def attachments_in_order(spark, sf_dir):
    bad = F.col("l_returnflag") == "R"
    made = {"filename": text("f", F.col("l_partkey")), "sha256": F.when(~bad, text("h", F.col("l_partkey"))), "extract_status": F.when(bad, "failed").otherwise("ok")}
    own = F.struct(*((made[f.name] if f.name in made else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.ATTACHMENT))
    files = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("source_id"), F.struct("l_linenumber", "l_partkey", "l_returnflag").alias("pos"), own.alias("attachment"))
    details = files.select("source_id").distinct().select("source_id", F.lit("body").alias("text"), F.lit("x").alias("content_hash"), F.lit(2).alias("hash_version"))
    rows = survey.with_attachments(details, files, portal=False)
    return rows.select("source_id", "content_hash", F.col("attachments_complete").alias("complete"), F.array_join(F.transform("attachments", lambda a: a["filename"]), ",").alias("names"))


# ---------------------------------------------------------------- attachments, names and addresses


@F.pandas_udf(T.BinaryType())
def zipped(numbers: pd.Series, texts: pd.Series) -> pd.Series:
    """Documents of two sections, 10 and 9, the later one first in the archive; every third has none."""

    def make(number, words):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for section in (10, 9):
                z.writestr(f"Contents/{'other' if number % 3 == 2 else 'section'}{section}.xml", f'<?xml version="1.0"?><hs:sec xmlns:hs="s" xmlns:hp="p"><hp:p><hp:t>{words} {section}</hp:t></hp:p></hs:sec>')
        return out.getvalue()

    return pd.Series([make(n, t) for n, t in zip(numbers, texts)])


@query("""
    select p_partkey, case p_partkey % 3 when 0 then 'ok' when 1 then 'unsupported' else 'failed' end as status, case p_partkey % 3 when 1 then 'unsupported_extension' when 2 then 'hwpx_no_sections' else '' end as reason,
      case when p_partkey % 3 = 0 then p_name || ' 9' || chr(10) || p_name || ' 10' else '' end as body from part
""")
def zipped_documents(spark, sf_dir):
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 1, "x.xyz").otherwise("x.HWPX").alias("name"), zipped(k, F.col("p_name")).alias("content"))
    found = rows.select("p_partkey", attachments.extracted(F.col("name"), F.col("content")).alias("r"))
    return found.select("p_partkey", attachments.extract_status(F.col("r")).alias("status"), F.col("r.reason").alias("reason"), F.col("r.text").alias("body"))


@query("""select p_partkey, case when p_partkey % 4 = 3 then 'file_not_found' when p_partkey % 4 = 0 then 'hwp_binary_unsupported' else 'unsupported_extension' end as reason from part""")
def unreadable_documents(spark, sf_dir):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, "a/공고.HWP").when(k == 1, ".hwp").when(k == 2, "name.tar").otherwise("x.pdf")
    found = attachments.extracted(name, F.when(k != 3, F.encode("p_name", "UTF-8")))
    return table(spark, sf_dir, "part").select("p_partkey", found.alias("r")).select("p_partkey", F.col("r.reason").alias("reason"))


@query("""select '/f/' || p_partkey as path, true as ok, p_name as body, '' as reason from part where p_partkey % 5 <> 0 union all select '/f/' || p_partkey, false, null, 'broken' from part where p_partkey % 5 = 0""")
def extraction_sink(spark, sf_dir):
    """What was extracted is written as texts, what wasn't as markers without any text."""
    ok = F.col("p_partkey") % 5 != 0
    result = F.struct(ok.alias("ok"), F.when(ok, F.col("p_name")).otherwise("").alias("text"), F.when(ok, "").otherwise("broken").alias("reason"))
    path = work_dir(spark, "extracted")
    sinks.write_extracted(table(spark, sf_dir, "part").select(text("/f/", F.col("p_partkey")).alias("path"), result.alias("result")), path)
    texts = spark.read.parquet(f"{path}/texts").select("path", F.lit(True).alias("ok"), F.col("text").alias("body"), "reason")
    failed = spark.read.schema("path string, ok boolean, reason string").json(f"{path}/failed")
    return texts.unionByName(failed.select("path", "ok", F.lit(None).cast("string").alias("body"), "reason"))


@query("""
    select cast(l_orderkey as varchar) as source_id, cast(l_linenumber as bigint) as pos, case when l_returnflag = 'R' then 'blocked_redirect' when l_partkey % 2 = 0 then 'skipped_robots' when l_partkey % 3 = 0 then 'failed' else 'ok' end as download,
      case when l_returnflag <> 'R' and l_partkey % 2 = 1 and l_partkey % 3 <> 0 then 'unsupported' else 'skipped' end as extract,
      case when l_returnflag <> 'R' and l_partkey % 2 = 1 and l_partkey % 3 <> 0 then sha256('part ' || l_partkey) end as digest from lineitem
""")
def attachments_processed(spark, sf_dir):
    """Lines as links to the files of parts: of another host, on a disallowed path, without a file, or downloaded."""
    part, line = F.col("l_partkey"), table(spark, sf_dir, "lineitem")
    address = lambda c: text("https://files.example.org/", F.when(c % 2 == 0, "x/../private/").otherwise("open/"), c)
    url = F.when(F.col("l_returnflag") == "R", text("https://files.example.org.evil/", part)).otherwise(address(part))
    links = line.select(F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_linenumber").cast("long").alias("pos"), url.alias("url"), F.lit("f.txt").alias("filename"))
    k = F.col("l_partkey")
    content = F.encode(text("part ", k), "UTF-8")
    files = line.select("l_partkey").distinct().where("l_partkey % 3 <> 0").select(address(k).alias("url"), text("/files/", k, ".txt").alias("path"), F.length(content).cast("long").alias("length"), content.alias("content"), F.sha2(content, 256).alias("sha256"))
    found = attachments.processed(links, files, ["example.org"], ["/private"])
    return found.select("source_id", "pos", F.col("attachment.download_status").alias("download"), F.col("attachment.extract_status").alias("extract"), F.col("attachment.sha256").alias("digest"))


@query("""
    select page_id, not starts_with(path, '/en') as allowed, not starts_with(path, '/en') as encoded, false as malformed, false as deep from (select page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) as path from pages)
""")
def robots_paths(spark, sf_dir):
    """The same path plainly, percent-encoded once, with a broken escape, and encoded so often that nobody can tell."""
    url = F.col("url")
    host, path = F.regexp_extract(url, "^[a-z]+://[^/?#]*", 0), F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)
    cases = {"allowed": url, "encoded": F.concat(host, F.regexp_replace(path, "e", "%65")), "malformed": F.concat(host, path, F.lit("%zz")), "deep": F.concat(host, path, F.lit("%252525252525252541"))}
    return table(spark, sf_dir, "pages").select("page_id", *(U.robots_allowed(c, ["/en"]).alias(n) for n, c in cases.items()))


@query("""
    select page_id, case page_id % 5 when 0 then 'fanfandaero' when 1 then 'fanfandaero' when 2 then 'seoulshinbo' end as source, case page_id % 5 when 0 then 'ntc-' || page_id when 1 then 'biz-' || page_id when 2 then 'ntc-' || page_id end as source_id from pages
""")
def detail_targets(spark, sf_dir):
    k = F.col("page_id")
    url = F.element_at(F.array(text("https://fanfandaero.kr/v.do?nttId=", k), text("https://www.FANFANDAERO.kr/v.do?sprtBizCd=", k), text("https://www.seoulshinbo.co.kr/wbase/contents/bbs/view/", k, ".do?p=1"), text("http://fanfandaero.kr/v.do?nttId=", k), text("https://fanfandaero.kr.evil.example/v.do?nttId=", k)), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", U.detail_target(url).alias("t")).select("page_id", "t.source", "t.source_id")


@query(r"""
    select p_partkey, lpad(cast(p_partkey % 120 as varchar), case when p_partkey % 120 < 10 then 2 else cast(length(cast(p_partkey % 120 as varchar)) as integer) end, '0') || '_' || case when p_partkey % 7 = 0 then 'attach' else '공고 ' || p_partkey || '_(1).hwp' end as by_number,
      case when p_partkey % 7 = 0 then 'abcdefgh-' || p_partkey else 'abcdefgh_공고 ' || p_partkey || '_(1).hwp' end as by_id from part
""")
def safe_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 7 == 0, "../x/").otherwise(text("..\\a/b\\공고 ", k, "?(1).hwp"))
    return table(spark, sf_dir, "part").select("p_partkey", U.safe_filename(name, k % 120).alias("by_number"), U.safe_filename_by_id(text("abcdefgh-", k), name).alias("by_id"))


@query("""select doc_id, replace(text, '%', '') as fixed, replace(text, '%', '') as same from documents""")
def mojibake(spark, sf_dir):
    """Texts that were read as Latin-1 are repaired, and whole ones stay."""
    whole = F.replace("text", F.lit("%"), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", U.fix_mojibake(F.decode(F.encode(whole, "UTF-8"), "ISO-8859-1")).alias("fixed"), U.fix_mojibake(whole).alias("same"))


@query("""select c_custkey, 'failed: k=[REDACTED]&x=' || c_custkey || ' or [REDACTED] or [REDACTED]' as message from customer""")
def redacted_keys(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", U.redact(text("failed: k=a%2Fb%20c%2B%3D&x=", F.col("c_custkey"), " or a/b c+= or a%2Fb+c%2B%3D"), "a/b c+=").alias("message"))


# ---------------------------------------------------------------- snapshots, sinks and streams


@query("""
    select p_partkey, p_partkey % 6 in (0, 5) as collected from part
""")
def snapshot_file_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.element_at(F.array(text("bizinfo", k, ".jsonl"), F.lit("screening.jsonl"), text("verdicts-", k, ".jsonl"), text("merged", k, ".jsonl"), F.lit("new_items.jsonl"), text("x-screen", k, ".jsonl")), (k % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", snapshots.collected_file(name).alias("collected"))


@query("""select o_orderpriority as source, cast(o_orderkey as varchar) as source_id, 'order ' || o_orderkey as title, o_orderstatus as gubun from orders where o_orderkey % 5 <> 0""")
def snapshot_folder(spark, sf_dir):
    """A folder of collected rows, among which are rows of a diff and of a screening file, which don't count."""
    path = work_dir(spark, "snapshot")
    rows = order_listing(spark, sf_dir)
    other = F.col("source_id").cast("long") % 10
    rows = rows.withColumn("kind", F.when(other == 0, "NEW")).withColumn("record", F.when(other == 0, "x")).withColumn("screening", F.when(other == 5, "candidate")).withColumn("title", F.when(other != 5, F.col("title")))
    rows.write.json(path)
    found = snapshots.checked(snapshots.read_snapshot(spark, path, "*.json"))
    return found.select("source", "source_id", "title", F.col("raw")["pbancGubun"].alias("gubun"))


@query("""
    select o_orderpriority as source, cast(o_orderkey as varchar) as source_id, case when o_orderkey % 9 = 0 then 'missing key' else 'repeated key' end as problem, cast(case when o_orderkey % 7 = 0 then 2 else 1 end as bigint) as n
    from (select case when o_orderkey % 9 = 0 then '' else o_orderpriority end as o_orderpriority, o_orderkey from orders) where o_orderkey % 9 = 0 or o_orderkey % 7 = 0
""")
def snapshot_violations(spark, sf_dir):
    k = F.col("source_id").cast("long")
    rows = order_listing(spark, sf_dir).withColumn("source", F.when(k % 9 == 0, "").otherwise(F.col("source")))
    return snapshots.violations(rows.unionByName(rows.where(k % 7 == 0)))


PROFILE = sorted(snapshots.PROFILE_FIELDS)
PROFILE_SQL = " || ', ' || ".join({"province": "'\"province\": \"' || c_mktsegment || '\"'", "headcount": "'\"headcount\": \"' || c_custkey || '\"'", "needs": "'\"needs\": \"| - loan | - grant\"'"}.get(f, f"'\"{f}\": null'") for f in PROFILE).replace('"| - loan', '"- loan')


@query(f"""select c_custkey, c_mktsegment as province, left(sha256('{{' || {PROFILE_SQL} || '}}'), 16) as fingerprint from customer""")
def profile_fingerprints(spark, sf_dir):
    """Front matter with a comment, a list and a field that verdicts don't depend on."""

    @F.pandas_udf("province string, fingerprint string")
    def read(profiles: pd.Series) -> pd.DataFrame:
        fields = [snapshots.parse_profile(p) for p in profiles]
        return pd.DataFrame({"province": [f.get("province") for f in fields], "fingerprint": [snapshots.fingerprint(f) for f in fields]})

    profile = text("---\nprovince: ", F.col("c_mktsegment"), " # where\nnickname: n\nheadcount: ", F.col("c_custkey"), "\nneeds:\n  - loan\n  - grant # first\n---\nbody: x")
    return table(spark, sf_dir, "customer").select("c_custkey", read(profile).alias("r")).select("c_custkey", "r.*")


@query("""select o_orderpriority as source, cast(o_orderkey as varchar) as source_id, 'order ' || o_orderkey as title, strftime(o_orderdate, '%Y-%m-%d') as apply_end from orders""")
def announcement_sink(spark, sf_dir):
    path = work_dir(spark, "announcements")
    sinks.write_announcements(order_listing(spark, sf_dir).withColumns({"page": F.lit(1), "pos": F.lit(1)}), path)
    return spark.read.schema(S.ANNOUNCEMENT).json(path).select("source", "source_id", "title", "apply_end")


@query("""
    select case when o_orderkey % 3 = 0 then 'NEW' when o_orderkey % 5 = 0 then 'GONE' else 'CHANGED' end as kind, cast(o_orderkey as varchar) as source_id, o_orderkey % 3 <> 0 and o_orderkey % 5 = 0 as gone from orders where o_orderkey % 3 = 0 or o_orderkey % 5 = 0 or o_orderkey % 7 = 0
""")
def diff_sink(spark, sf_dir):
    k = F.col("source_id").cast("long")
    rows = order_listing(spark, sf_dir).withColumn("source", F.lit("s"))
    compared = diff.compare(rows.where(k % 3 != 0), rows.where((k % 3 == 0) | (k % 5 != 0)).withColumn("title", F.when(k % 7 == 0, "changed").otherwise(F.col("title"))))
    path = work_dir(spark, "diff")
    sinks.write_diff(compared, path)
    parts = [spark.read.schema(f"kind string, record struct<source_id: string>").json(f"{path}/{part}").select("kind", "record.source_id", F.lit(part == "gone").alias("gone")) for part in ("review", "gone")]
    return parts[0].unionByName(parts[1])


@query("""
    select cast(o_orderkey as varchar) as source_id, 'https://x/' || o_orderkey || chr(10) || 'CONTENT_HASH ' || o_orderstatus || chr(10) || 'HASH_VERSION 2' || chr(10) || 'ATTACHMENTS a.pdf, ' || o_orderkey || '.hwp' || chr(10) || chr(10) || 'body' as body from orders
""")
def detail_texts(spark, sf_dir):
    k = F.col("k")
    files = F.array(*(F.struct(name.alias("filename")) for name in (F.lit("a.pdf"), text(k, ".hwp"))))
    rows = orders(spark, sf_dir).select(s(k).alias("source_id"), text("https://x/", k).alias("url"), F.col("status").alias("content_hash"), F.lit(2).alias("hash_version"), files.alias("attachments"), F.lit("body").alias("body"))
    return rows.select("source_id", sinks.detail_text().alias("body"))


@query("""select o_orderpriority as source, count(*) as n from orders group by 1""")
def incremental_append(spark, sf_dir):
    """Files land twice, and each run takes what is new."""
    landed, out, checkpoint = (work_dir(spark, n) for n in ("landed", "stream", "offsets"))
    for part in (0, 1):
        order_listing(spark, sf_dir, F.col("o_orderkey") % 2 == part).write.mode("append").json(landed)
        ingest.append(ingest.announcements(spark, landed), out, checkpoint).awaitTermination()
    return spark.read.parquet(out).groupBy(F.col("source").cast("string").alias("source")).agg(F.count("*").alias("n"))


@query("""select o_orderpriority as source, cast(o_orderkey as varchar) as source_id, case when o_orderkey % 3 = 0 then 'later' else 'order ' || o_orderkey end as title from orders""")
def incremental_upsert(spark, sf_dir):
    """A second landing repeats every third announcement with another title: the later row counts, and the others stay."""
    landed, base, checkpoint = (work_dir(spark, n) for n in ("landed", "upserted", "offsets"))
    rows = order_listing(spark, sf_dir).withColumn("crawled_at", F.lit("2026-01-01"))
    again = rows.where(F.col("source_id").cast("long") % 3 == 0).withColumn("title", F.lit("later")).withColumn("crawled_at", F.lit("2026-01-02"))
    for part in (rows, again):
        part.write.mode("append").json(landed)
        ingest.upsert(ingest.announcements(spark, landed), base, checkpoint, 8).awaitTermination()
    return ingest.current(spark, base, ingest.announcements(spark, landed).schema).select("source", "source_id", "title")


# ---------------------------------------------------------------- programmes, verdicts and reports


@query(f"""select cast(k as varchar) as source_id, cast(min(k) over (partition by k // 10) as varchar) as least, count(*) over (partition by k // 10) as size from {ORDERS}""")
def programme_groups(spark, sf_dir):
    """Announcements of two sources, ten of which are one programme: each shares its agency and number with one neighbour, and its address with the other."""
    k = F.col("k")
    address = F.when((k % 10).isin(0, 9), text("https://x/own", k)).otherwise(text("https://x/", F.floor((k + 1) / 2)))
    rows = orders(spark, sf_dir).select(*listings.record(source=F.when(k % 2 == 0, "x").otherwise("y"), source_id=s(k), agency=F.lit("agency"), announce_no=text(" n  ", F.floor(k / 2)), canonical_url=address))
    found = same_programmes(rows)
    least = found.groupBy("programme").agg(F.min(F.col("source_id").cast("long")).cast("string").alias("least"))
    return found.join(least, "programme").select("source_id", "least", "size")


@query(f"""select cast(k as varchar) as source_id, case when k % 3 = 0 or k % 4 = 0 then true else false end as recheck from {ORDERS}""")
def carry_over_confirmed(spark, sf_dir):
    """Nothing changed: loans and confirmed announcements are looked at again all the same."""
    k, rows = F.col("source_id").cast("long"), order_listing(spark, sf_dir)
    verdicts = rows.select("source", "source_id", F.when(k % 3 == 0, "loan").when(k % 3 == 1, "grant").alias("primary_type"), F.when(k % 4 == 0, "확인됨").when(k % 4 == 1, "조건부").alias("verdict"))
    return diff.carried_over(diff.compare(rows, rows), verdicts).select("source_id", "recheck")


@query(f"""
    select cast(k as varchar) as source_id, case k % 3 when 0 then 0 when 1 then 1 else 2 end as type_rank, cast(k % 5 as integer) as verdict_rank from {ORDERS}
""")
def type_sections(spark, sf_dir):
    return judged(spark, sf_dir).select("source_id", report.type_rank().alias("type_rank"), report.verdict_rank().alias("verdict_rank"))


def judged(spark, sf_dir) -> DataFrame:
    k = F.col("source_id").cast("long")
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (k % n + 1).cast("int"))
    return order_listing(spark, sf_dir).withColumn("primary_type", pick(report.TYPES, 3)).withColumn("verdict", pick(report.VERDICTS, 5))


@query(f"""select case k % 3 when 0 then 'grant' when 1 then 'loan' else 'advisory' end as primary_type, case k % 5 when 0 then '확인됨' when 1 then '조건부' when 2 then '확인 필요' when 3 then '신청 불가' else '사업전환 후보' end as verdict, count(*) as n from {ORDERS} group by 1, 2""")
def type_counts(spark, sf_dir):
    rows = judged(spark, sf_dir)
    return report.type_counts(rows.drop("verdict"), rows.select("source", "source_id", "verdict"))


@query("""select cast(o_orderkey as varchar) as source_id from orders where o_orderkey % 4 = 1""")
def needs_detail(spark, sf_dir):
    key = F.col("source_id").cast("long")
    return report.needs_detail(order_listing(spark, sf_dir).withColumn("status", F.when(key % 4 == 1, X.UNKNOWN).when(key % 4 == 2, X.OPEN))).select("source_id")


@query("""
    select c_custkey, case when c_custkey % 2 = 0 then 'confirmed' when c_custkey % 3 = 0 and c_custkey % 5 = 0 then 'confirmed' when c_custkey % 7 = 0 then 'needs_check' else 'unknown' end as status from customer
""")
def legal_status(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", report.small_business_status(k % 2 == 0, k % 3 == 0, k % 5 == 0, k % 7 == 0).alias("status"))


@query("""select n_name as source, n_nationkey % 2 = 0 as automatic from nation where n_regionkey = 2""")
def registry_sources(spark, sf_dir):
    registry = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("province"), F.col("n_name").alias("source"), (F.col("n_nationkey") % 2 == 0).alias("automatic"))
    return report.sources_for(F.lit(2), registry).select("source", "automatic")


@query("""
    select s_name as source from supplier where s_suppkey % 7 in (1, 2, 3, 4, 5)
""")
def manifest_check(spark, sf_dir):
    """Counts that can't be right, unknown words, and a partial source that calls itself complete."""
    k = F.col("s_suppkey") % 7
    status = F.when(k == 5, "done").otherwise("success")
    screening = F.when(k == 6, "partial").otherwise("success")
    rows = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("source"), status.alias("collection_status"), screening.alias("screening_status"), F.lit(10).cast("long").alias("collected"), F.when(k == 1, 11).when(k.isin(2, 6), 9).otherwise(10).alias("screened"), F.when(k == 3, 12).otherwise(5).alias("candidate"), F.when(k == 4, 6).otherwise(5).alias("detail_verified"))
    return report.manifest_errors(rows).select("source")


@query(f"""
    select priority as source, cast(k as varchar) as source_id, r.rule from {ORDERS} o join (values ('loan terms'), ('unknown status'), ('one verdict')) r(rule)
      on (r.rule = 'loan terms' and k % 3 = 0 and k % 4 <> 0) or (r.rule = 'unknown status' and k % 5 = 0) or (r.rule = 'one verdict' and k % 8 = 0)
""")
def loan_terms(spark, sf_dir):
    """Loans need all their terms, whatever the verdict; a confirmed announcement a known status; and each exactly one verdict."""
    k = F.col("source_id").cast("long")
    terms = F.create_map(*(x for name in ("loan_limit", "loan_rate", "loan_term", "loan_office") for x in (F.lit(name), F.when(k % 4 == 0, "x").otherwise("" if name == "loan_term" else "x"))))
    rows = order_listing(spark, sf_dir).withColumn("primary_type", F.when(k % 3 == 0, "loan").otherwise("grant")).withColumn("raw", terms).withColumn("attachments_complete", F.lit(True)).withColumn("status", F.when(k % 5 == 0, X.UNKNOWN).otherwise(X.OPEN))
    verdicts = rows.select("source", "source_id", F.when(k % 5 == 0, "확인됨").otherwise("조건부").alias("verdict"))
    return report.verdict_errors(rows, verdicts.unionByName(verdicts.where(k % 8 == 0)))


@query(f"""
    select cast(k as varchar) as source_id, case when k % 3 = 0 and k % 2 = 0 then 'services' else 'deadlines' end as section, cast(case when k % 2 = 0 then 2 else 0 end as integer) as rank, cast(case when k % 2 = 1 then date_diff('day', date '{AS_OF}', d) end as integer) as days_left from {ORDERS}
""")
def services_section(spark, sf_dir):
    """Always-open services of the open API have a section of their own; always-open announcements of other sources don't."""
    k = F.col("source_id").cast("long")
    rows = order_listing(spark, sf_dir).withColumn("source", F.when(k % 3 == 0, "gov24").otherwise("bizinfo")).withColumn("status", F.when(k % 2 == 0, X.ALWAYS).otherwise(X.OPEN)).withColumn("apply_end", F.when(k % 2 == 1, F.col("apply_end")))
    return report.deadline_list(rows, as_of()).select("source_id", "section", "rank", "days_left")
