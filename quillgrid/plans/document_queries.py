"""Queries over documents and their pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators import documents as d
from quillgrid.operators.checks import summarise_groups, totals_check
from quillgrid.functions import metadata as m
from quillgrid.plans import views as v
from quillgrid.plans.views import corner_columns, with_views
from quillgrid.sources.files import map_pages

_SIDES = ("top", "bottom", "left", "right")


def page_profile(spark: SparkSession, folder: str) -> DataFrame:
    metas = d.page_metadata(d.project_pages(v.pages(spark, folder)), v.blocks(spark, folder))
    rects = [
        F.col("inverse_rects")[side][c].alias(f"{side}_{c}") for side in _SIDES for c in ("x0", "y0", "x1", "y1")
    ]
    return metas.select(
        "doc_id", "page_number", "width", "height", "rotation", "has_text", "block_count",
        *corner_columns("content_frame", "frame"),
        *rects,
        *[F.col("margins")[side].alias(f"margin_{side}") for side in _SIDES],
    )


_PROFILE_SQL = """, frames as (
 select doc_id, page_number, count(*) block_count,
  coalesce(min(case when x1 > x0 and y1 > y0 then x0 end), 0) fx0, coalesce(min(case when x1 > x0 and y1 > y0 then y0 end), 0) fy0,
  coalesce(max(case when x1 > x0 and y1 > y0 then x1 end), 0) fx1, coalesce(max(case when x1 > x0 and y1 > y0 then y1 end), 0) fy1
 from fx_blocks group by doc_id, page_number),
placed as (
 select p.doc_id, p.page_number, width, height, rotation, coalesce(block_count, 0) block_count,
  coalesce(fx0, 0) fx0, coalesce(fy0, 0) fy0, coalesce(fx1, 0) fx1, coalesce(fy1, 0) fy1
 from fx_pages p left join frames f on f.doc_id = p.doc_id and f.page_number = p.page_number),
cut as (
 select *, """ + ", ".join(
    f"greatest(0, least(f{c}, {size})) c{c}" for c, size in zip(("x0", "y0", "x1", "y1"), ("width", "height") * 2)
) + " from placed)"

PAGE_PROFILE_SQL = with_views("fx_pages fx_blocks", "").rstrip() + _PROFILE_SQL + """
select doc_id, page_number, width, height, rotation, block_count > 0 has_text, block_count,
 fx0 frame_x0, fy0 frame_y0, fx1 frame_x1, fy1 frame_y1,
 0.0::double top_x0, 0.0::double top_y0, width top_x1, cy0 top_y1,
 0.0::double bottom_x0, cy1 bottom_y0, width bottom_x1, height bottom_y1,
 0.0::double left_x0, cy0 left_y0, cx0 left_x1, cy1 left_y1,
 cx1 right_x0, cy0 right_y0, width right_x1, cy1 right_y1,
 cy0 margin_top, height - cy1 margin_bottom, cx0 margin_left, width - cx1 margin_right
from cut"""


def raw_margins(spark: SparkSession, folder: str) -> DataFrame:
    """Margins that are negative where blocks overflow, on pages whose rectangle begins off the origin."""
    pages = d.project_pages(v.pages(spark, folder)).withColumns(
        {"origin_x": 12.0 * (F.col("doc_id") % 3), "origin_y": 40.0 * (F.col("page_number") % 2)}
    )
    metas = d.page_metadata(pages, v.blocks(spark, folder), clamp_nonnegative=False)
    return metas.select(
        "doc_id", "page_number",
        *[F.col("margins")[side].alias(f"margin_{side}") for side in _SIDES],
        F.col("inverse_rects.left.x0").alias("left_x0"),
        F.col("inverse_rects.top.y1").alias("top_y1"),
    )


RAW_MARGINS_SQL = with_views("fx_pages fx_blocks", "").rstrip() + _PROFILE_SQL + """,
moved as (select *, 12.0::double * (doc_id % 3) ox, 40.0::double * (page_number % 2) oy from placed)
select doc_id, page_number, fy0 - oy margin_top, oy + height - fy1 margin_bottom, fx0 - ox margin_left, ox + width - fx1 margin_right,
 ox left_x0, greatest(oy, least(fy0, oy + height)) top_y1 from moved"""


def document_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Profiles of five pages, laid out as one row per page to compare them."""
    profiles = d.document_profiles(v.docmeta(spark, folder), v.pages(spark, folder), v.blocks(spark, folder), limit=5)
    doc = F.col("document")
    return (
        profiles.select(
            "doc_id",
            doc["tag"].alias("tag"),
            doc["creator"].alias("creator"),
            doc["format"].alias("format"),
            F.try_element_at(doc["dates"], F.lit("creationDate")).alias("created"),
            F.size(doc["dates"]).alias("date_count"),
            F.size("pages").alias("profiled_pages"),
            F.explode("pages").alias("page"),
        )
        .select(
            "*",
            F.col("page.page_number").alias("page_number"),
            F.col("page.block_count").alias("block_count"),
            F.col("page.margins.left").alias("margin_left"),
            F.col("page.margins.bottom").alias("margin_bottom"),
        )
        .drop("page")
    )


_TAG_SQL = "concat_ws('|', " + ", ".join(
    f"case when {a} <> '' then concat('{a}|', regexp_replace({a}, '\\s+', '', 'g')) end" for a in m.ACCESSORS
) + ")"


def _date_sql(column: str) -> str:
    return (
        f"try_strptime(substr(list_filter(regexp_split_to_array({column}, '[:\\-D]'), lambda x: x <> '')[1], 1, 8),"
        " '%Y%m%d')::date"
    )


DOCUMENT_PROFILE_SQL = with_views("fx_pages fx_blocks fx_docmeta", "").rstrip() + _PROFILE_SQL + f""",
docs as (select doc_id, {_TAG_SQL} tag, nullif(creator, '') creator, format, {_date_sql('creation_date')} created,
  {_date_sql('mod_date')} modified from fx_docmeta)
select cut.doc_id, tag, creator, format, created,
 cast((created is not null)::int + (modified is not null)::int as int) date_count,
 cast(count(*) over (partition by cut.doc_id) as int) profiled_pages,
 page_number, block_count, cx0 margin_left, height - cy1 margin_bottom
from cut join docs on docs.doc_id = cut.doc_id where page_number < 5"""


def document_identity(spark: SparkSession, folder: str) -> DataFrame:
    docs = v.table(spark, folder, "documents").select(
        "doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("source_path"), "text"
    )
    return d.with_identity(docs, "source_path", "text").drop("text")


DOCUMENT_IDENTITY_SQL = """select doc_id, concat(source, '/', doc_id) source_path, sha256(concat(source, '/', doc_id)) id,
 sha256(text) content_hash, 'local' source_type from documents"""


def document_validation(spark: SparkSession, folder: str) -> DataFrame:
    named = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"))
    pages = v.pages(spark, folder).withColumn("doc_id", named)
    # Lines of under sixty characters count as page furniture here, so that some documents have no text.
    blocks = v.blocks(spark, folder).filter(F.length("text") >= 60).withColumn("doc_id", named)
    checked = d.validate_documents(v.catalogue(spark, folder), pages, blocks)
    return checked.select(
        "doc_id", "source_path", "page_count", F.col("error.code").alias("code"), F.col("error.message").alias("message")
    )


DOCUMENT_VALIDATION_SQL = with_views("fx_pages fx_catalogue fx_blocks", """
select c.doc_id, source_path, page_count, code,
 case code when 'NO_PAGES' then concat('PDF ''', source_path, ''' has no pages.')
  when 'NO_SIZE' then concat('PDF ''', source_path, ''' has a page with no width or height.')
  when 'NO_TEXT' then concat('PDF ''', source_path, ''' has a page with no text.') end message
from (select c.doc_id, any_value(source_path) source_path, count(page_number) page_count,
  case when count(page_number) = 0 then 'NO_PAGES'
   when bool_or(page_number = 0 and (width = 0 or height = 0)) then 'NO_SIZE'
   when c.doc_id not in (select concat('doc/', doc_id) from fx_blocks where length("text") >= 60) then 'NO_TEXT' end code
 from fx_catalogue c left join fx_pages p on c.doc_id = concat('doc/', p.doc_id) group by c.doc_id) c""")


def metadata_tag(spark: SparkSession, folder: str) -> DataFrame:
    docs = d.document_metadata(v.docmeta(spark, folder))
    doc = F.col("document")
    return docs.select(
        "doc_id",
        *[doc[a].alias(a) for a in m.ACCESSORS],
        doc["tag"].alias("tag"),
        F.size(doc["raw"]).alias("raw_size"),
        doc["trailer"].alias("trailer"),
    )


_RAW_FIELDS = [*m.ACCESSORS, "creation_date", "mod_date", "format"]
METADATA_TAG_SQL = with_views("fx_docmeta", f"""
select doc_id, {', '.join(f"nullif({a}, '') {a}" for a in m.ACCESSORS)}, {_TAG_SQL} tag,
 cast({' + '.join(f"(coalesce({a}, '') <> '')::int" for a in _RAW_FIELDS)} as int) raw_size, trailer
from fx_docmeta""")


def pdf_dates(spark: SparkSession, folder: str) -> DataFrame:
    dates = F.col("dates")
    return v.docmeta(spark, folder).select("doc_id", m.document_dates().alias("dates")).select(
        "doc_id",
        F.try_element_at(dates, F.lit("creationDate")).alias("created"),
        F.try_element_at(dates, F.lit("modDate")).alias("modified"),
        F.array_join(F.array_sort(F.map_keys(dates)), ",").alias("date_keys"),
    )


PDF_DATES_SQL = with_views("fx_docmeta", f"""
select doc_id, created, modified, concat_ws(',', case when created is not null then 'creationDate' end,
 case when modified is not null then 'modDate' end) date_keys
from (select doc_id, {_date_sql('creation_date')} created, {_date_sql('mod_date')} modified from fx_docmeta)""")


def page_slice(spark: SparkSession, folder: str) -> DataFrame:
    return d.slice_pages(d.project_pages(v.pages(spark, folder)), 2, 6)


PAGE_SLICE_SQL = with_views("fx_pages", """
select doc_id, page_number, width, height, rotation
from (select *, row_number() over (partition by doc_id order by page_number) - 1 i from fx_pages) where i >= 2 and i < 6""")


def page_head(spark: SparkSession, folder: str) -> DataFrame:
    return d.head_pages(d.project_pages(v.pages(spark, folder)), 5)


PAGE_HEAD_SQL = with_views("fx_pages", """
select doc_id, page_number, width, height, rotation
from (select *, row_number() over (partition by doc_id order by page_number) rn from fx_pages) where rn <= 5""")


def page_batches(spark: SparkSession, folder: str) -> DataFrame:
    return d.batch_pages(d.project_pages(v.pages(spark, folder)), 4).select(
        "doc_id", "page_number", "batch",
        (F.col("width") * F.col("height")).alias("area"),
        (F.col("width") > F.col("height")).alias("is_landscape"),
    )


PAGE_BATCHES_SQL = with_views("fx_pages", """
select doc_id, page_number, cast((row_number() over (partition by doc_id order by page_number) - 1) // 4 as int) batch,
 width * height area, width > height is_landscape from fx_pages""")


def page_map(spark: SparkSession, folder: str) -> DataFrame:
    """The same page facts through a user function over Arrow batches."""

    def facts(batch):
        return batch.assign(area=batch.width * batch.height, is_landscape=batch.width > batch.height)[
            ["doc_id", "page_number", "area", "is_landscape"]
        ]

    schema = "doc_id bigint, page_number int, area double, is_landscape boolean"
    return map_pages(d.project_pages(v.pages(spark, folder)), facts, schema, partitions=6)


PAGE_MAP_SQL = with_views(
    "fx_pages", "select doc_id, page_number, width * height area, width > height is_landscape from fx_pages"
)


def page_counts(spark: SparkSession, folder: str) -> DataFrame:
    return d.page_counts(v.pages(spark, folder))


PAGE_COUNTS_SQL = with_views("fx_pages", "select doc_id, cast(max(page_number) + 1 as bigint) page_count from fx_pages group by doc_id")


def totals(spark: SparkSession, folder: str) -> DataFrame:
    rows = v.table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_extendedprice")
    return totals_check(rows, v.declared_totals(spark, folder), "l_extendedprice")


TOTALS_SQL = with_views("fx_statement_totals", """
select t.doc_id, declared_total, summed_total, summed_total - declared_total difference, summed_total = declared_total matches
from fx_statement_totals t join (select l_orderkey, cast(sum(cast(l_extendedprice as decimal(18,2))) as decimal(28,2)) summed_total
 from lineitem group by 1) s on s.l_orderkey = t.doc_id""")


def group_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per source: texts, characters and the first text, through the user-aggregate hook."""

    def partial(texts):
        return {"texts": len(texts), "chars": int(texts.str.len().sum()), "first_text": texts.min()}

    def merge(parts):
        return {"texts": int(parts.texts.sum()), "chars": int(parts.chars.sum()), "first_text": parts.first_text.min()}

    docs = v.table(spark, folder, "documents").select("source", "text")
    return summarise_groups(docs, "source", "text", partial, merge, "texts bigint, chars bigint, first_text string")


GROUP_SUMMARY_SQL = """select source, count(*) texts, cast(sum(length(text)) as bigint) chars, min(text) first_text
from documents group by source"""

QUERIES = {
    "page_profile": page_profile,
    "raw_margins": raw_margins,
    "document_profile": document_profile,
    "document_identity": document_identity,
    "document_validation": document_validation,
    "metadata_tag": metadata_tag,
    "pdf_dates": pdf_dates,
    "page_slice": page_slice,
    "page_head": page_head,
    "page_batches": page_batches,
    "page_map": page_map,
    "page_counts": page_counts,
    "totals_check": totals,
    "group_label_summary": group_summary,
}
ORACLES = {
    "page_profile": PAGE_PROFILE_SQL,
    "raw_margins": RAW_MARGINS_SQL,
    "document_profile": DOCUMENT_PROFILE_SQL,
    "document_identity": DOCUMENT_IDENTITY_SQL,
    "document_validation": DOCUMENT_VALIDATION_SQL,
    "metadata_tag": METADATA_TAG_SQL,
    "pdf_dates": PDF_DATES_SQL,
    "page_slice": PAGE_SLICE_SQL,
    "page_head": PAGE_HEAD_SQL,
    "page_batches": PAGE_BATCHES_SQL,
    "page_map": PAGE_MAP_SQL,
    "page_counts": PAGE_COUNTS_SQL,
    "totals_check": TOTALS_SQL,
    "group_label_summary": GROUP_SUMMARY_SQL,
}
