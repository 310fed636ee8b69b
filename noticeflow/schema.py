"""Types of the announcement data model. Files are always read with these, never with inferred types."""

from __future__ import annotations

from pyspark.sql import types as T

TEXT, LONG, FLAG = T.StringType(), T.LongType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def texts(*names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names, TEXT)


ATTACHMENT = struct(**texts("file_id", "filename"), size=LONG, **texts("url", "pbanc_sn", "local_path", "download_status", "sha256", "extract_status", "extract_reason", "text_path"))
ANNOUNCEMENT = struct(
    **texts("source", "source_id", "announce_no", "canonical_url", "title", "agency", "region_scope", "apply_start", "apply_end", "status", "primary_type"),
    tags=T.ArrayType(TEXT),
    attachments=T.ArrayType(ATTACHMENT),
    attachments_complete=FLAG,
    **texts("crawled_at", "content_hash"),
    hash_version=T.IntegerType(),
    raw=T.MapType(TEXT, TEXT),
)
PERIOD = struct(**texts("from", "to"))


def answer(default: T.DataType) -> T.StructType:
    """The envelope of the JSON lists and details."""
    return struct(result=FLAG, data=struct(default=default))


#: Items of the two JSON list modes.
LIST_ITEM = struct(
    **texts("pbancSn", "pbancId", "pbancNm", "rcrtTypeCdNm"),
    rcptPd=PERIOD,
    **texts("aplyPd", "aplyPsbltySe", "regionNmList", "hstgNm", "departNm", "bizType", "pbancGubun", "pbancKindCd", "bizYr", "ddlnDayCnt"),
)
LIST_PAGE = answer(struct(total=LONG, list=T.ArrayType(LIST_ITEM)))
YEAR_PAGE = struct(
    years=T.ArrayType(TEXT),
    list=T.ArrayType(struct(**texts("sprtBizCd", "sprtBizNm", "sprtBizCtpvNm", "rcritBgngYmd", "rcritEndYmd", "sprtBizTyNm", "sprtBizTrgtNm", "sprtBizYr"))),
)
#: Rows of the open API keep their field names as map keys, since those differ between its versions.
API_PAGE = struct(page=LONG, perPage=LONG, totalCount=LONG, currentCount=LONG, data=T.ArrayType(T.MapType(TEXT, TEXT)))
DETAIL = answer(struct(**texts("pbancSn", "pbancNm", "pbancDtlCn"), rcptPd=PERIOD, pbancSttsCd=TEXT))
FILES = answer(struct(list=T.ArrayType(struct(fileId=TEXT, fileNm=TEXT, fileSz=LONG))))
EXTRACTION = struct(ok=FLAG, **texts("text", "reason"))
