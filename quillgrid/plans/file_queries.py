"""Queries over file listings: sync plans, catalogue views and navigation."""

from __future__ import annotations

import itertools
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.functions import files as fn
from quillgrid.operators import grams as gr
from quillgrid.operators import listing as ls
from quillgrid.operators import sync as sy
from quillgrid.operators.checks import class_overview, resolve_uris
from quillgrid.operators.entities import fold_to_map
from quillgrid.operators.numbering import slice_rows, with_position
from quillgrid.plans import views as v
from quillgrid.plans.views import with_views
from quillgrid.session import materialise, scratch_path
from quillgrid.sources.connector import register_connector

ROOT, PREFIX = "/Docs", "in/"


def pdf_listing(spark: SparkSession, folder: str) -> DataFrame:
    """PDFs of the source with the object URI that stands for them in the target."""
    found = sy.pdf_files(v.source_listing(spark, folder))
    keys = v.target_listing(spark, folder).select(
        F.concat(F.lit("/Docs/"), F.substring("key", 4, 1 << 20)).alias("local_path"),
        fn.object_uri("archive", F.col("key")).alias("uri"),
    )
    named = found.select(F.col("path_display").alias("file"), fn.basename(F.col("path_display")).alias("name"), "size")
    return resolve_uris(named, keys)


PDF_LISTING_SQL = with_views("fx_src_listing fx_dst_listing", """
select coalesce(case when d."key" is not null then concat('s3://archive/', d."key") end, path_display) file, "name", size
from fx_src_listing s left join fx_dst_listing d on concat('/Docs/', substr(d."key", 4)) = path_display
where is_file and lower("name") like '%.pdf'""")


def sync_plan(spark: SparkSession, folder: str) -> DataFrame:
    plan = sy.plan_sync(v.source_listing(spark, folder), v.target_listing(spark, folder), root=ROOT, prefix=PREFIX)
    return plan.select("path_display", "key", "action", "last_modified")


_PLAN_SQL = """, plan as (
 select path_display, concat('in/', substr(path_display, 7)) "key", last_modified,
  case when d."key" is null then 'upload_new' when server_modified <= last_modified then 'skip' else 'upload_newer' end "action"
 from fx_src_listing s left join fx_dst_listing d on d."key" = concat('in/', substr(path_display, 7))
 where is_file and lower("name") like '%.pdf')"""
SYNC_PLAN_SQL = (
    with_views("fx_src_listing fx_dst_listing", "").rstrip() + _PLAN_SQL
    + '\nselect path_display, "key", "action", last_modified from plan'
)


def sync_plan_forced(spark: SparkSession, folder: str) -> DataFrame:
    """Every PDF again, with the lenient key rule that removes the root text anywhere."""
    plan = sy.plan_sync(
        v.source_listing(spark, folder), v.target_listing(spark, folder),
        root="C1", prefix="copy", force=True, strict_prefix=False,
    )
    return plan.select("path_display", "key", "action")


SYNC_PLAN_FORCED_SQL = with_views("fx_src_listing", """
select path_display, replace(concat('copy/', ltrim(replace(ltrim(path_display, '/'), 'C1', ''), '/')), '//', '/') "key",
 'forced' "action" from fx_src_listing where is_file and lower("name") like '%.pdf'""")


def sync_summary(spark: SparkSession, folder: str) -> DataFrame:
    source = v.source_listing(spark, folder)
    plan = sy.plan_sync(source, v.target_listing(spark, folder), root=ROOT, prefix=PREFIX)
    plan = materialise(plan.select("path_display", "key", "action"))  # read twice below
    failed = plan.filter(F.lower("key").endswith("7.pdf")).select("key")
    summary = sy.sync_summary(source, plan, failed)
    return summary.withColumn("uploaded_keys", F.array_join("uploaded_keys", ","))


SYNC_SUMMARY_SQL = with_views("fx_src_listing fx_dst_listing", "").rstrip() + _PLAN_SQL + """
select (select count(*) from fx_src_listing where is_file) scanned, count(*) filter ("action" <> 'skip' and lower("key") not like '%7.pdf') uploaded,
 count(*) filter ("action" = 'skip') skipped, count(*) filter ("action" <> 'skip' and lower("key") like '%7.pdf') errors,
 (select string_agg("key", ',' order by path_display) from
  (select * from plan where "action" <> 'skip' and lower("key") not like '%7.pdf' order by path_display limit 100)) uploaded_keys
from plan"""


def folder_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Children of every folder in display order: folders first, then names, descending."""
    listed = v.files(spark, folder).withColumn("parent", fn.parent_folder(F.col("path")))
    order = ls.name_keys(descending=True, collation=None)
    return with_position(listed, ["parent"], order).select("parent", "name", "file_type", "position")


FOLDER_LISTING_SQL = with_views("fx_files", """
select parent, "name", file_type, row_number() over (partition by parent
  order by case when file_type = 'folder' then 0 else 1 end, "name" desc, id) "position"
from (select *, coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') parent from fx_files)""")


def folder_browse(spark: SparkSession, folder: str) -> DataFrame:
    """One folder with all listing filters on, numbered in name order."""
    kept = ls.browse(
        v.files(spark, folder), "medium/s%20F", source="dropbox", extensions=["pdf", "xlsx"], ignore=r"F1\d*\.PDF$"
    )
    return with_position(kept, [], ls.name_keys(collation=None)).select("id", "name", "path", "source", "position")


FOLDER_BROWSE_SQL = with_views("fx_files", """
select id, "name", path, source, row_number() over (order by "name", id) "position" from fx_files
where regexp_matches(path, '^/medium/s%20F/[^/]*$') and source = 'dropbox' and (file_type = 'folder' or file_ext in ('pdf', 'xlsx'))
 and not regexp_matches(path, 'f1[0-9]*\\.pdf$')""")


def file_search(spark: SparkSession, folder: str) -> DataFrame:
    """Names containing a text, of two strict types, newest first, numbered per source."""
    hits = ls.of_types_strict(ls.named_like(v.files(spark, folder), "F12"), ["pdf", "docx"])
    return with_position(hits, ["source"], ls.time_keys(descending=True)).select(
        "source", "id", "name", "modified_time", "position"
    )


FILE_SEARCH_SQL = with_views("fx_files", """
select source, id, "name", modified_time,
 row_number() over (partition by source order by modified_time desc, id) "position"
from fx_files where contains(lower("name"), 'f12') and file_ext in ('pdf', 'docx')""")


def file_slice(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 10 to 19 of every source by path, and all rows of a folder from index 1000 on."""
    files = v.files(spark, folder).select("source", "path", "file_type")
    part = slice_rows(files, ["source"], [F.col("path")], 10, 20).withColumn("part", F.lit("bounded"))
    tail = slice_rows(files, ["file_type"], [F.col("path")], 1000).withColumn("part", F.lit("open"))
    return part.unionByName(tail)


FILE_SLICE_SQL = with_views("fx_files", """
select source, path, file_type, 'bounded' part from
 (select *, row_number() over (partition by source order by path) - 1 i from fx_files) where i >= 10 and i < 20
union all
select source, path, file_type, 'open' part from
 (select *, row_number() over (partition by file_type order by path) - 1 i from fx_files) where i >= 1000""")


def file_display(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("size")
    return v.files(spark, folder).select(
        "id", "path",
        fn.human_size(size).alias("human_size"),
        fn.human_size(size * size).alias("large_size"),
        fn.size_in_mb(size).alias("size_mb"),
        fn.display_time(F.col("modified_time")).alias("modified"),
        fn.parent_folder(F.col("path")).alias("parent"),
        fn.basename(F.col("path")).alias("basename"),
    )


def _size_sql(size: str, unit: int) -> str:
    carry = f"((({size}) % {unit}) * 100 + {unit // 2}) // {unit}"
    return f"concat(({size}) // {unit} + ({carry}) // 100, '.', lpad(cast(({carry}) % 100 as varchar), 2, '0'))"


def _human_sql(size: str) -> str:
    steps = " ".join(
        f"when {size} < {1024 ** (p + 1)} then concat({_size_sql(size, 1024**p)}, ' {u}')" for p, u in ((1, "KB"), (2, "MB"), (3, "GB"))
    )
    return f"case when coalesce({size}, 0) < 1024 then concat(coalesce({size}, 0), ' B') {steps} else concat({_size_sql(size, 1024**4)}, ' TB') end"


FILE_DISPLAY_SQL = with_views("fx_files", f"""
select id, path, {_human_sql('size')} human_size, {_human_sql('(size * size)')} large_size,
 case when size is not null then concat({_size_sql('size', 1024**2)}, ' MB') end size_mb,
 coalesce(strftime(modified_time, '%d %b %Y %H:%M'), '—') modified,
 coalesce(nullif(regexp_extract(path, '^(.*)/[^/]*$', 1), ''), '/') parent, split_part(path, '/', -1) basename
from fx_files""")


def breadcrumbs(spark: SparkSession, folder: str) -> DataFrame:
    crumbs = v.files(spark, folder).select("path", F.posexplode(fn.breadcrumbs(F.col("path"))).alias("depth", "crumb"))
    return crumbs.select(
        F.col("path").alias("file"), "depth", F.col("crumb.name").alias("name"), F.col("crumb.path").alias("path")
    )


BREADCRUMBS_SQL = with_views("fx_files", """
select path file, cast(i as int) depth, case when i = 0 then 'Home' else url_decode(segs[i]) end "name",
 array_to_string(segs[1:i], '/') path
from (select path, segs, unnest(range(len(segs) + 1)) i from
 (select path, list_filter(string_split(path, '/'), lambda s: s <> '') segs from fx_files))""")


def shared_initials(spark: SparkSession, folder: str) -> DataFrame:
    """Initials of the people an order's file is shared with."""
    names = [
        F.lower(F.substring("o_orderpriority", 3, 20)),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")),
        F.when(F.col("o_totalprice") > 200000, F.lit("éric")),
        F.lit("zed"),
    ]
    shared = F.array(*[F.struct(n.alias("name")) for n in names])
    return v.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"), F.array_join(fn.shared_initials(shared), "").alias("initials")
    )


SHARED_INITIALS_SQL = """select o_orderkey id, concat(upper(substr(o_orderpriority, 3, 1)),
 case when o_orderstatus = 'P' then '?' else upper(o_orderstatus) end,
 case when o_totalprice > 200000 then 'É' else '?' end) initials from orders"""


def file_navigation(spark: SparkSession, folder: str) -> DataFrame:
    return ls.navigation(v.files(spark, folder), ["source"], ls.name_keys(collation=None)).select(
        "source", "id", "position", "file_count", "previous_id", "next_id"
    )


FILE_NAVIGATION_SQL = with_views("fx_files", """
select source, id, row_number() over w "position", count(*) over (partition by source) file_count,
 lag(id) over w previous_id, lead(id) over w next_id
from fx_files window w as (partition by source order by case when file_type = 'folder' then 0 else 1 end, "name", id)""")


def sample_pager(spark: SparkSession, folder: str) -> DataFrame:
    """Samples of every class (language) by id, with clamped neighbour indices."""
    docs = v.table(spark, folder, "documents").select(F.col("lang").alias("classification"), F.col("doc_id").alias("sample"))
    numbered = with_position(docs, ["classification"], [F.col("sample")], total="sample_count")
    return ls.pager(numbered).drop("position")


SAMPLE_PAGER_SQL = """select lang classification, doc_id sample, sample_count, i "index", greatest(i - 1, 0) previous_index,
 least(i + 1, sample_count - 1) next_index
from (select lang, doc_id, count(*) over (partition by lang) sample_count,
 row_number() over (partition by lang order by doc_id) - 1 i from documents)"""


def class_map(spark: SparkSession, folder: str) -> DataFrame:
    """Per class: the last source seen, sample count, and its label (the quality of its last rated sample)."""
    docs = v.table(spark, folder, "documents").select("doc_id", "lang", "source")
    last = F.max_by("lang", "doc_id").alias("last_lang")
    seen = docs.groupBy(F.col("source").alias("classification")).agg(last, F.count(F.lit(1)).alias("samples"))
    rated = docs.join(v.table(spark, folder, "labels"), "doc_id")
    labels = fold_to_map(rated, "source", "quality", "doc_id").select(
        F.col("source").alias("classification"), F.concat(F.lit("quality "), F.col("quality").cast("string")).alias("label"),
        (F.col("quality") == 1).alias("is_original"),
    )
    indices = rated.filter("toxic = 1").groupBy(F.col("source").alias("classification")).agg(F.count(F.lit(1)).cast("int").alias("page_index"))
    return class_overview(seen, labels, indices)


CLASS_MAP_SQL = """select c.classification, last_lang, samples, coalesce("label", '') "label",
 coalesce(is_original, false) is_original, cast(coalesce(page_index, 0) as int) page_index
from (select source classification, arg_max(lang, doc_id) last_lang, count(*) samples from documents group by source) c
left join (select source classification, concat('quality ', arg_max(quality, d.doc_id)) "label",
  arg_max(quality, d.doc_id) = 1 is_original, nullif(count(*) filter (toxic = 1), 0) page_index
 from documents d join labels l on l.doc_id = d.doc_id group by source) r on r.classification = c.classification"""


def library_totals(spark: SparkSession, folder: str) -> DataFrame:
    return ls.library_totals(v.files(spark, folder), ["source"], overall="all")


LIBRARY_TOTALS_SQL = with_views("fx_files", """
select coalesce(source, 'all') source, count(*) file_count, cast(coalesce(sum(size), 0) as bigint) total_size
from fx_files group by rollup (source)""")


def facet_counts(spark: SparkSession, folder: str) -> DataFrame:
    return ls.facet_counts(v.files(spark, folder), ["source", "file_ext", "file_type"])


FACET_COUNTS_SQL = with_views("fx_files", """
select 'source' facet, source "value", count(*) n from fx_files group by source
union all select 'file_ext', file_ext, count(*) from fx_files group by file_ext
union all select 'file_type', file_type, count(*) from fx_files group by file_type""")

RULES = [(r"(?i)^/urgent/.*\.pdf$", "urgent report"), (r"\.(xlsx|docx)$", "office"), (r"^/(high|urgent)/", "priority")]


def auto_label(spark: SparkSession, folder: str) -> DataFrame:
    return v.files(spark, folder).select("path", ls.auto_label(F.col("path"), RULES, "other").alias("label"))


AUTO_LABEL_SQL = with_views("fx_files", """
select path, case when regexp_matches(lower(path), '^/urgent/.*\\.pdf$') then 'urgent report'
 when regexp_matches(path, '\\.(xlsx|docx)$') then 'office' when regexp_matches(path, '^/(high|urgent)/') then 'priority'
 else 'other' end "label" from fx_files""")


def rule_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Labels of all paths by a rule per customer, which claims ten orders' reports, and three general rules."""
    customers = v.table(spark, folder, "customer")
    own = customers.select(
        F.col("c_custkey").alias("rule_id"),
        F.col("c_custkey").alias("priority"),
        F.concat(F.lit("/f"), F.col("c_custkey").cast("string"), F.lit("\\d\\.pdf$")).alias("pattern"),
        F.lower("c_mktsegment").alias("label"),
    )
    general = gr.frame_of(spark, [(-1, 10**9, "(?i)^/URGENT/s%20[FO]", "urgent"), (-2, 10**9 + 1, "\\.p.g$", "picture"), (-3, 0, "(/f7777)\\d*.xlsx", "sevens")])
    return gr.label_by_rules(v.files(spark, folder).select("path"), "path", own.unionByName(general), "other")


RULE_LABELS_SQL = with_views("fx_files", """
select path, case when regexp_matches(path, '/f7777[0-9]*.xlsx') then 'sevens' when c_custkey is not null then lower(c_mktsegment)
  when regexp_matches(path, '^/urgent/s%20[FO]') then 'urgent' when regexp_matches(path, '\\.p.g$') then 'picture' else 'other' end "label"
from fx_files left join customer on c_custkey = try_cast(regexp_extract(path, '/f([0-9]+)[0-9]\\.pdf$', 1) as bigint)""")


def name_search(spark: SparkSession, folder: str) -> DataFrame:
    """Names that hold the number of an order of value, for all such orders at once, through stored grams."""
    files = v.files(spark, folder).select("id", "name")
    path = scratch_path(spark, "name-grams")
    gr.write_grams(files, path)
    rich = v.table(spark, folder, "orders").filter("o_totalprice > 400000 and o_orderkey > 99")
    patterns = rich.select(F.col("o_orderkey").alias("pattern_id"), F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("pattern"))
    short = spark.createDataFrame([(-1, "F1")], patterns.schema)
    return gr.search_grams(spark, path, files, patterns.unionByName(short))


NAME_SEARCH_SQL = with_views("fx_files", """
select o_orderkey pattern_id, id, name from orders join fx_files on starts_with(name, concat('f', o_orderkey))
where o_totalprice > 400000 and o_orderkey > 99
union all select -1, id, name from fx_files where contains(lower(name), 'f1')""")


_LISTED = "path_display string, name string, is_file boolean, rev string, size bigint"
_LISTED_NAMES = [c.split()[0] for c in _LISTED.split(", ")]


# Rows of one stored file, and so of one task of the connector.
_FILE_ROWS = 100_000


class StoredPager:
    """A stand-in for a user's pager: roots are folders of JSON lines, a page is some lines of a file.

    A cursor is the number of a file and a byte in it, so a page costs the same wherever it begins.
    """

    def __init__(self, folder: str, lines: int = 500):
        self._folder, self._lines = folder.removeprefix("file://").removeprefix("file:"), lines
        self._listed: tuple[str | None, list[str]] = (None, [])

    def _files(self, root: str) -> list[str]:
        folder = os.path.join(self._folder, f"root={root}")
        return sorted(os.path.join(folder, f) for f in os.listdir(folder) if f.endswith(".json"))

    def roots(self) -> list[str]:
        return sorted(f.removeprefix("root=") for f in os.listdir(self._folder) if f.startswith("root="))

    def cuts(self, root: str) -> list[str]:
        return [f"{i}:0" for i in range(1, len(self._files(root)))]

    def page(self, root: str, cursor: str | None) -> tuple[list[tuple], str, bool]:
        if cursor is None or self._listed[0] != root:
            self._listed = root, self._files(root)  # once for all pages of a part
        files = self._listed[1]
        file, at = map(int, (cursor or "0:0").split(":"))
        if file >= len(files):
            return [], f"{file}:0", False
        with open(files[file], "rb") as f:
            f.seek(at)
            found = list(itertools.islice(f, self._lines))
            more = f.tell() < os.fstat(f.fileno()).st_size
        records = map(json.loads, found)
        rows = [tuple(map(r.get, _LISTED_NAMES)) for r in records]
        after = f"{file}:{at + sum(map(len, found))}" if more else f"{file + 1}:0"
        return rows, after, more or file + 1 < len(files)

    def latest(self, root: str) -> str:
        return f"{len(self._files(root))}:0"


def connector_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Files of three of the four roots of a store, listed page by page through the connector."""
    listing = v.source_listing(spark, folder)
    root = F.concat(F.lit("shelf"), (F.length("path_display") % 4).cast("string"))
    path = scratch_path(spark, "store")
    stored = listing.select(root.alias("root"), *_LISTED_NAMES).write.option("maxRecordsPerFile", _FILE_ROWS)
    stored.partitionBy("root").json(path)
    register_connector(spark, "stored_pages", _LISTED, lambda: StoredPager(path))
    return spark.read.format("stored_pages").load().filter("is_file and root in ('shelf0', 'shelf1', 'shelf2')")


CONNECTOR_LISTING_SQL = with_views("fx_src_listing", """
select concat('shelf', length(path_display) % 4) root, path_display, name, is_file, rev, size from fx_src_listing
where is_file and length(path_display) % 4 <> 3""")

QUERIES = {
    "pdf_listing": pdf_listing,
    "connector_listing": connector_listing,
    "sync_plan": sync_plan,
    "sync_plan_forced": sync_plan_forced,
    "sync_summary": sync_summary,
    "folder_listing": folder_listing,
    "folder_browse": folder_browse,
    "file_search": file_search,
    "file_slice": file_slice,
    "file_display": file_display,
    "breadcrumbs": breadcrumbs,
    "shared_initials": shared_initials,
    "file_navigation": file_navigation,
    "sample_pager": sample_pager,
    "class_map": class_map,
    "library_totals": library_totals,
    "facet_counts": facet_counts,
    "auto_label": auto_label,
    "rule_labels": rule_labels,
    "name_search": name_search,
}
ORACLES = {
    "pdf_listing": PDF_LISTING_SQL,
    "connector_listing": CONNECTOR_LISTING_SQL,
    "sync_plan": SYNC_PLAN_SQL,
    "sync_plan_forced": SYNC_PLAN_FORCED_SQL,
    "sync_summary": SYNC_SUMMARY_SQL,
    "folder_listing": FOLDER_LISTING_SQL,
    "folder_browse": FOLDER_BROWSE_SQL,
    "file_search": FILE_SEARCH_SQL,
    "file_slice": FILE_SLICE_SQL,
    "file_display": FILE_DISPLAY_SQL,
    "breadcrumbs": BREADCRUMBS_SQL,
    "shared_initials": SHARED_INITIALS_SQL,
    "file_navigation": FILE_NAVIGATION_SQL,
    "sample_pager": SAMPLE_PAGER_SQL,
    "class_map": CLASS_MAP_SQL,
    "library_totals": LIBRARY_TOTALS_SQL,
    "facet_counts": FACET_COUNTS_SQL,
    "auto_label": AUTO_LABEL_SQL,
    "rule_labels": RULE_LABELS_SQL,
    "name_search": NAME_SEARCH_SQL,
}
