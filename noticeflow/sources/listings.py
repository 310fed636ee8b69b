"""Landed listing pages as announcement rows.

Readers give (page, pos, item...) or (page, body) rows; parsers turn them into announcements with the columns ``page`` and ``pos``, which the keep rules of
``operators.dedup`` order by. ``as_of`` is the survey's date: statuses never depend on the clock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noticeflow import schema as S
from noticeflow.functions import pages as P
from noticeflow.functions import text as X

#: Addresses of the sites.
SBIZ = "https://www.sbiz24.kr"
BIZINFO = "https://www.bizinfo.go.kr"
FANFAN = "https://fanfandaero.kr"
SSB = "https://www.seoulshinbo.co.kr"
SSB_BOARD = "STRY9788"
#: Field names of the open API, by version, and what they mean.
ID_KEYS = ("서비스ID", "SVC_ID", "svcId", "serviceId")
FIELD_KEYS = {
    "title": ("서비스명",),
    "purpose": ("서비스목적요약", "서비스목적"),
    "deadline": ("신청기한",),
    "target": ("지원대상",),
    "criteria": ("선정기준",),
    "content": ("지원내용",),
    "how": ("신청방법",),
    "docs": ("구비서류",),
    "recv_org": ("접수기관명", "접수기관"),
    "org": ("소관기관명",),
    "dept": ("부서명",),
    "type": ("지원유형",),
    "tel": ("문의처전화번호", "전화문의"),
    "url": ("온라인신청사이트URL", "상세조회URL"),
    "updated": ("수정일시",),
    "user_type": ("사용자구분",),
    "field": ("서비스분야",),
}

#: Rows of the portal's table, links in them, posts of the two boards, and cells. A dot that stands for line ends too is matched much faster than [\s\S].
PORTAL_ROW = r"(?s)<tr>.*?</tr>"
PORTAL_LINK = r'(?s)href\s*=\s*"([^"]*pblancId=(PBLN_\d+)[^"]*)"[^>]*>\s*(.*?)</a>'
FANFAN_POST = r"""(?s)detailPage\('(\d+)'\);?"[^>]*class="title"[^>]*>(.*?)</a>.*?<span class="date">([^<]*)</span>"""
SSB_POST = r"""(?s)goView\('\d+',\s*'(\d+)'\)"><span class="ellipsis">(.*?)</span></a></td>(.*?)</tr>"""
CELL = r"(?s)<td[^>]*>(.*?)</td>"


def page_number() -> Column:
    """The page that a landed file holds: the last number in its name."""
    return F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""), r"(\d+)\D*$", 1), F.lit("")).try_cast("int"), F.lit(0))


def read_json_pages(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("page", page_number())


def read_html_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(page_number().alias("page"), F.col("value").alias("body"))


def record(**own: Column | str | None) -> list[Column]:
    """The columns of an announcement, with the values that a listing leaves at their defaults."""
    default = {"attachments_complete": F.lit(False), "tags": F.array().cast("array<string>"), "attachments": F.array().cast(S.ANNOUNCEMENT["attachments"].dataType)}
    out = []
    for field in S.ANNOUNCEMENT:
        value = own.get(field.name, default.get(field.name))
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast(field.dataType).alias(field.name))
    return out


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def exploded(pages: DataFrame, items: str) -> DataFrame:
    return pages.select("page", F.posexplode(items).alias("pos", "item"))


def sbiz_notices(pages: DataFrame, mode: str, as_of: Column, crawled_at: Column) -> DataFrame:
    """Announcements of the JSON list in mode ``pbanc`` (the agency's own) or ``combine`` (all agencies')."""
    i = exploded(pages, "data.default.list")
    start, end = (X.empty_to_null(F.col(f"item.rcptPd.{x}")) for x in ("from", "to"))
    common = {
        "title": or_empty(F.col("item.pbancNm")),
        "region_scope": F.coalesce(X.empty_to_null(F.col("item.regionNmList")), F.lit("전국")),
        "status": X.status_by_code(F.col("item.aplyPsbltySe"), end, F.col("item.aplyPd"), as_of),
        "tags": X.split_tags(F.col("item.hstgNm")),
        "crawled_at": crawled_at,
        "raw": X.without_nulls(**{k: F.col(f"item.{k}") for k in ("rcrtTypeCdNm", "bizType", "pbancKindCd", "pbancGubun", "ddlnDayCnt", "bizYr")}),
    }
    if mode == "pbanc":
        number = or_empty(F.col("item.pbancSn"))
        own = {"source": "sbiz24", "source_id": number, "canonical_url": F.concat(F.lit(f"{SBIZ}/#/pbanc/"), number), "agency": "소상공인시장진흥공단", "apply_start": start, "apply_end": end}
    else:
        number = F.coalesce(X.empty_to_null(F.col("item.pbancId")), F.col("item.pbancSn"), F.lit(""))
        period = X.halves(F.col("item.aplyPd"))
        own = {
            "source": "sbiz24_combine",
            "source_id": number,
            "announce_no": F.when(number.startswith("PBLN"), number),
            "canonical_url": canonical_url(number, F.col("item.pbancGubun")),
            "agency": F.coalesce(X.empty_to_null(F.col("item.departNm")), X.empty_to_null(F.col("item.rcrtTypeCdNm")), F.lit("미상")),
            "apply_start": period["start"],
            "apply_end": period["end"],
        }
    return i.select("page", "pos", *record(**common, **own))


def canonical_url(number: Column, namespace: Column) -> Column:
    """The detail address of the namespace that a combined number belongs to."""
    path = F.when(number.startswith("PBLN"), "extldPbanc").when(namespace == "C", "loanProduct").otherwise("pbanc")
    return F.concat(F.lit(f"{SBIZ}/#/"), path, F.lit("/"), number)


def sbiz_detail(pages: DataFrame) -> DataFrame:
    """Details: id, title, body and period as the detail answer has them."""
    d = "data.default."
    return pages.select(
        or_empty(F.col(d + "pbancSn")).alias("source_id"),
        or_empty(F.col(d + "pbancNm")).alias("title"),
        X.strip_tags_inline(F.col(d + "pbancDtlCn")).alias("body_text"),
        X.empty_to_null(F.col(d + "rcptPd.from")).alias("apply_start"),
        X.empty_to_null(F.col(d + "rcptPd.to")).alias("apply_end"),
        F.col(d + "pbancSttsCd").alias("status_code"),
    )


def sbiz_files(pages: DataFrame, source_id: str) -> DataFrame:
    """Attachments of a detail answer's file list; those without an id aren't files."""
    rows = pages.select(F.col(source_id).cast("string").alias("pbanc_sn"), F.posexplode("data.default.list").alias("pos", "f")).where(or_empty(F.col("f.fileId")) != "")
    return rows.select("pos", F.col("f.fileId").alias("file_id"), or_empty(F.col("f.fileNm")).alias("filename"), F.col("f.fileSz").alias("size"), F.concat(F.lit(f"{SBIZ}/api/cmmn/file/"), F.col("f.fileId")).alias("url"), "pbanc_sn")


def cells_of(row: Column) -> Column:
    """Cleaned cells of a table row."""
    raw = F.regexp_extract_all(row, F.lit(CELL), 1)
    text = F.array_join(F.transform(raw, lambda c: X.squeeze(F.regexp_replace(c, "<[^>]+>", " "))), "\u0000")
    return F.transform(F.split(X.unescape(text), "\u0000"), X.squeeze)


def cell(i: int) -> Column:
    return or_empty(F.get(F.col("cells"), F.lit(i)))


def bizinfo_notices(pages: DataFrame, as_of: Column, crawled_at: Column) -> DataFrame:
    """Announcements of the portal's table: rows that link to a detail page."""
    rows = pages.select("page", F.posexplode(F.regexp_extract_all("body", F.lit(PORTAL_ROW), 0)).alias("pos", "row")).where(F.col("row").rlike(PORTAL_LINK))
    parts = rows.select("page", "pos", F.regexp_extract("row", PORTAL_LINK, 2).alias("number"), X.clean(F.regexp_extract("row", PORTAL_LINK, 3)).alias("name"), cells_of(F.col("row")).alias("cells"))
    parts = parts.withColumn("period", X.split_period(cell(3), cleaned=True))
    number, end = F.col("number"), F.col("period.end")
    return parts.select(
        "page",
        "pos",
        *record(
            source="bizinfo",
            source_id=number,
            announce_no=number,
            canonical_url=F.concat(F.lit(f"{BIZINFO}/sii/siia/selectSIIA200Detail.do?pblancId="), number),
            title=F.col("name"),
            agency=F.when(F.size("cells") > 5, X.join_filled(cell(4), cell(5))).otherwise(""),
            apply_start=X.empty_to_null(F.col("period.start")),
            apply_end=X.empty_to_null(end),
            status=X.status_by_end(end, as_of),
            tags=X.one_tag(cell(1)),
            crawled_at=crawled_at,
            raw=X.without_nulls(field=cell(1), reg_date=cell(6)),
        ),
    )


def fanfan_notices(pages: DataFrame, as_of: Column, crawled_at: Column) -> DataFrame:
    """Programmes of the yearly JSON lists."""
    i = exploded(pages, "list").where(or_empty(F.col("item.sprtBizCd")) != "")
    code, end = F.col("item.sprtBizCd"), X.empty_to_null(X.clean(F.col("item.rcritEndYmd")))
    return i.select(
        "page",
        "pos",
        *record(
            source="fanfandaero",
            source_id=F.concat(F.lit("biz-"), code),
            announce_no=F.concat(F.lit("biz-"), code),
            canonical_url=F.concat(F.lit(f"{FANFAN}/portal/v2/preSprtBizPbancDetail.do?sprtBizCd="), code),
            title=X.clean(F.col("item.sprtBizNm")),
            agency="중소기업유통센터(판판대로)",
            region_scope=X.empty_to_null(X.clean(F.col("item.sprtBizCtpvNm"))),
            apply_start=X.empty_to_null(X.clean(F.col("item.rcritBgngYmd"))),
            apply_end=end,
            status=X.status_by_end(end, as_of),
            tags=X.one_tag(X.clean(F.col("item.sprtBizTyNm"))),
            crawled_at=crawled_at,
            raw=X.without_nulls(target=X.clean(F.col("item.sprtBizTrgtNm")), biz_year=X.clean(F.col("item.sprtBizYr"))),
        ),
    )


def board_rows(pages: DataFrame, pattern: str) -> DataFrame:
    """(page, pos, row) for each match of a board's row pattern."""
    return pages.select("page", F.posexplode(F.regexp_extract_all("body", F.lit(pattern), 0)).alias("pos", "row"))


def fanfan_board(pages: DataFrame, crawled_at: Column) -> DataFrame:
    """Posts of the notice board; they carry no period, so their status is unknown."""
    rows = board_rows(pages, FANFAN_POST)
    number, name, date = (F.regexp_extract("row", FANFAN_POST, i) for i in (1, 2, 3))
    key = F.concat(F.lit("ntc-"), number)
    return rows.select(
        "page",
        "pos",
        *record(
            source="fanfandaero",
            source_id=key,
            announce_no=key,
            canonical_url=F.concat(F.lit(f"{FANFAN}/portal/v2/readUcenterNtcBbsView.do?nttId="), number),
            title=X.clean(name),
            agency="중소기업유통센터(판판대로)",
            status=X.UNKNOWN,
            crawled_at=crawled_at,
            raw=X.without_nulls(posted=F.substring(X.norm_date(date), 1, 10), board=F.lit("공지사항")),
        ),
    )


def ssb_board(pages: DataFrame, crawled_at: Column) -> DataFrame:
    """Posts of the guarantee fund's board. Its markup holds every post twice, for two kinds of screens: the first on a page counts."""
    rows = board_rows(pages, SSB_POST)
    parts = rows.select("page", "pos", F.regexp_extract("row", SSB_POST, 1).alias("number"), X.clean(F.regexp_extract("row", SSB_POST, 2)).alias("name"), cells_of(F.regexp_extract("row", SSB_POST, 3)).alias("cells"))
    first = parts.groupBy("page", "number").agg(F.min_by(F.struct("pos", "name", "cells"), "pos").alias("first")).select("page", "number", "first.*")
    dates = F.filter(F.transform("cells", lambda c: X.norm_date(c, cleaned=True)), lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$"))
    number, key = F.col("number"), F.concat(F.lit("ntc-"), F.col("number"))
    return first.select(
        "page",
        "pos",
        *record(
            source="seoulshinbo",
            source_id=key,
            announce_no=key,
            canonical_url=F.concat(F.lit(f"{SSB}/wbase/contents/bbs/view/"), number, F.lit(f".do?mng_cd={SSB_BOARD}&pageIndex=1")),
            title=F.col("name"),
            agency=F.when(cell(0) == "", "서울신용보증재단").otherwise(F.concat(F.lit("서울신용보증재단/"), cell(0))),
            region_scope="서울",
            status=X.UNKNOWN,
            crawled_at=crawled_at,
            raw=X.without_nulls(posted=or_empty(F.get(dates, F.lit(0))), board=F.lit(f"공지사항({SSB_BOARD})")),
        ),
    )


def api_field(item: Column, keys: tuple[str, ...]) -> Column:
    return X.first_filled(*(item[k] for k in keys))


def gov24_fields(item: Column) -> dict[str, Column]:
    return {name: api_field(item, keys) for name, keys in FIELD_KEYS.items()}


def gov24_services(pages: DataFrame, as_of: Column, crawled_at: Column, needle: str | None = None) -> DataFrame:
    """Services of the open API that have an id and a title and, if asked, hold a word in title, target, content or purpose."""
    rows = exploded(pages, "data")
    item = F.col("item")
    f = gov24_fields(item)
    rows = rows.select("page", "pos", api_field(item, ID_KEYS).alias("number"), *(c.alias(k) for k, c in f.items()))
    rows = rows.where((or_empty(F.col("number")) != "") & (or_empty(F.col("title")) != ""))
    if needle:
        rows = rows.where(contains_word(needle, "title", "target", "content", "purpose"))
    number, due = F.col("number"), X.status_by_deadline(F.col("deadline"), as_of)
    return rows.withColumn("due", due).select(
        "page",
        "pos",
        *record(
            source="gov24",
            source_id=number,
            announce_no=number,
            canonical_url=F.coalesce(X.empty_to_null(F.col("url")), F.concat(F.lit("https://www.gov.kr/portal/rcvfvrSvc/dtlEx/"), number)),
            title=F.col("title"),
            agency=X.join_filled(F.col("org"), F.col("dept")),
            apply_end=F.col("due.end"),
            status=F.col("due.status"),
            tags=X.one_tag(F.col("type")),
            attachments_complete=F.lit(True),
            crawled_at=crawled_at,
            raw=X.without_nulls(**{k: F.col(k) for k in FIELD_KEYS}),
        ),
    )


def contains_word(needle: str, *columns: str) -> Column:
    """Whether the filled columns, joined by spaces, contain a word; it may reach across a border."""
    return F.concat_ws(" ", *(X.empty_to_null(F.col(c)) for c in columns)).contains(needle)


def gov24_hash(item: Column) -> Column:
    """Hash of a service's fields as JSON with sorted keys, nulls included; strings are written as JSON writes them, without escaping letters."""
    f = gov24_fields(item)
    quoted = {k: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r'^\{"x":([\s\S]*)\}$', 1), F.lit("")) for k, c in f.items()}
    parts = [F.concat(F.lit(f'"{k}": '), F.when(f[k].isNull(), "null").otherwise(quoted[k])) for k in sorted(f)]
    return F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256)


def gov24_details(pages: DataFrame, requested: str) -> DataFrame:
    """Details of requested ids; ``matched`` is false where the answer is of another id, and such a row must not be merged."""
    rows = pages.select(F.col(requested).cast("string").alias("source_id"), F.get("data", F.lit(0)).alias("item"))
    item = F.col("item")
    return rows.select("source_id", F.coalesce(api_field(item, ID_KEYS) == F.col("source_id"), F.lit(False)).alias("matched"), gov24_hash(item).alias("content_hash"), X.without_nulls(**gov24_fields(item)).alias("raw"))
