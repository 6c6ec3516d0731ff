"""Document-shaped views derived from the given tables, in Spark and as SQL for cross-checking.

Every view covers all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgrid.operators.detections import label_detections, number_detections
from quillgrid.sources.files import union_all

AS_OF = "2024-01-18 00:00:00"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- pages, blocks and metadata of documents -------------------------------
# Eight lines make a page; sheets are printed on both sides, so an odd page
# count gets an empty last page.


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return pages_of(table(spark, folder, "documents"))


def pages_of(documents: DataFrame) -> DataFrame:
    return documents.selectExpr(
        "doc_id",
        "explode(sequence(0, 2 * cast((size(split(text, '\n')) + 15) div 16 as int) - 1)) page_number",
        "case when n_chars < 40 then 0.0D when lang = 'de' then 792.0D else 612.0D end width",
        "case when n_chars < 40 then 0.0D when lang = 'de' then 612.0D else 792.0D end height",
        "cast((doc_id % 4) * 90 as int) rotation",
    )


def blocks(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "documents").selectExpr("doc_id", "posexplode(split(text, '\n')) as (i, line)")
    return lines.where("length(trim(line)) > 0").selectExpr(
        "doc_id",
        "cast(i div 8 as int) page_number",
        "cast(i % 8 as int) block_no",
        "72.0D x0",
        "36.0D + 90.0D * (i % 8) y0",
        "least(72.0D + 6.0D * length(line), 700.0D) x1",
        "46.0D + 90.0D * (i % 8) y1",
        "line as text",
    )


def docmeta(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").selectExpr(
        "doc_id",
        "case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else concat('Creator  ', source) end creator",
        "concat('Title ', cast(doc_id as string)) title",
        "lang author",
        "cast(null as string) subject",
        "case when doc_id % 3 = 0 then concat(lang, ', ', source) end keywords",
        "'Producer 1.0' producer",
        "concat('D:20240', cast(1 + doc_id % 9 as string), lpad(cast(1 + doc_id % 28 as string), 2, '0'),"
        " '103000-05''00''') creation_date",
        "case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then concat('2023-0', cast(1 + doc_id % 9 as string), '-01')"
        " else concat('D:20230', cast(1 + doc_id % 9 as string), lpad(cast(1 + doc_id % 27 as string), 2, '0'), '120000Z') end mod_date",
        "'PDF 1.7' format",
        "case when doc_id % 7 = 0 then concat('<< /Size ', cast(doc_id as string), ' >>') end trailer",
    )


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """All documents and all web pages; the latter have no PDF pages."""
    docs = table(spark, folder, "documents").selectExpr("concat('doc/', doc_id) doc_id", "concat(source, '/', doc_id) source_path")
    web = table(spark, folder, "pages").selectExpr("concat('web/', page_id) doc_id", "url source_path")
    return docs.unionByName(web)


# --- detections -------------------------------------------------------------


def detections(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey doc_id",
        "l_linenumber page_number",
        "l_quantity * 10 x1",
        "cast(l_suppkey % 100 as double) * 5 y1",
        "l_quantity * 10 + 20 + cast(l_partkey % 50 as double) x2",
        "cast(l_suppkey % 100 as double) * 5 + 10 + cast(l_partkey % 30 as double) y2",
        "1 - l_discount * 5 conf",
        "cast(l_partkey % 13 as int) cls",
    )


def numbered_detections(spark: SparkSession, folder: str) -> DataFrame:
    order = [F.col(c) for c in ("x1", "y1", "x2", "y2", "cls", "conf")]
    return number_detections(detections(spark, folder), order)


def layout_detections(spark: SparkSession, folder: str) -> DataFrame:
    """A detection per text block, on an image of twice the page size; some reach over the lines below."""
    found = blocks(spark, folder).selectExpr(
        "doc_id",
        "page_number",
        "cast(block_no + 1 as bigint) det_no",
        "2 * (x0 - 4) x1",
        "2 * (y0 - 4) y1",
        "2 * (x1 + 4) x2",
        "2 * (y1 + 4 + 90.0D * (length(text) % 3)) y2",
        "0.9D conf",
        "case when contains(text, ',') then 8 else 9 end cls",
    )
    return label_detections(found)


# --- file catalogue ---------------------------------------------------------


def files(spark: SparkSession, folder: str) -> DataFrame:
    """A file per order and a row per folder above it."""
    orders = table(spark, folder, "orders").selectExpr(
        "o_orderkey id",
        "case when o_orderkey % 5 < 2 then 'pdf' when o_orderkey % 5 = 2 then 'xlsx'"
        " when o_orderkey % 5 = 3 then 'docx' else 'png' end file_ext",
        "lower(substr(o_orderpriority, 3)) c",
        "o_orderstatus s",
        "cast(floor(o_totalprice * 10) as bigint) size",
        "o_orderdate modified_time",
        "case when o_custkey % 3 = 0 then 'dropbox' when o_custkey % 3 = 1 then 'google_drive' else 'local' end source",
    )
    leaves = orders.selectExpr(
        "id",
        "concat('f', cast(id as string), '.', file_ext) name",
        "concat('/', c, '/s%20', s, '/f', cast(id as string), '.', file_ext) path",
        "'file' file_type",
        "file_ext",
        "size",
        "modified_time",
        "source",
    )
    empty = ("'folder' file_type", "cast(null as string) file_ext", "cast(null as bigint) size",
             "cast(null as timestamp_ntz) modified_time", "'local' source")
    upper = orders.select("c").distinct().selectExpr("-ascii(c) id", "c name", "concat('/', c) path", *empty)
    lower = orders.select("c", "s").distinct().selectExpr(
        "-1000 * ascii(c) - ascii(s) id", "concat('s%20', s) name", "concat('/', c, '/s%20', s) path", *empty
    )
    return union_all([leaves, upper.withColumn("id", F.col("id").cast("bigint")), lower.withColumn("id", F.col("id").cast("bigint"))])


def source_listing(spark: SparkSession, folder: str) -> DataFrame:
    """A file per order and a folder per customer with orders."""
    orders = table(spark, folder, "orders")
    folders = orders.select("o_custkey").distinct().selectExpr(
        "concat('/Docs/C', cast(o_custkey as string)) path_display",
        "concat('C', cast(o_custkey as string)) name",
        "false is_file",
        "cast(null as string) rev",
        "cast(null as timestamp_ntz) server_modified",
        "cast(null as bigint) size",
    )
    return source_files(orders).unionByName(folders)


def source_files(orders: DataFrame) -> DataFrame:
    return orders.withColumn(
        "name",
        F.expr(
            "concat('f', cast(o_orderkey as string), case when o_orderkey % 3 = 0 then '.PDF'"
            " when o_orderkey % 3 = 1 then '.pdf' else '.txt' end)"
        ),
    ).selectExpr(
        "concat('/Docs/C', cast(o_custkey as string), '/', name) path_display",
        "name",
        "true is_file",
        "cast(o_orderkey as string) rev",
        "o_orderdate server_modified",
        "cast(floor(o_totalprice) as bigint) size",
    )


def target_listing(spark: SparkSession, folder: str) -> DataFrame:
    """An object per order with returned items, stored when the last of them was shipped."""
    returned = (
        table(spark, folder, "lineitem")
        .where("l_returnflag = 'R'")
        .groupBy("l_orderkey")
        .agg(F.max("l_shipdate").alias("last_modified"))
    )
    return returned.join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).selectExpr(
        "concat('in/C', cast(o_custkey as string), '/f', cast(o_orderkey as string), case when o_orderkey % 3 = 0"
        " then '.PDF' when o_orderkey % 3 = 1 then '.pdf' else '.txt' end) key",
        "last_modified",
    )


# --- users, tokens, tasks, totals, points -----------------------------------


def users(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey id",
        "concat('u', cast(c_custkey as string), '@', lower(c_mktsegment), '.example') email",
        "case when c_nationkey % 4 = 0 then null else c_name end full_name",
        "c_acctbal >= 0 is_active",
        "case when c_nationkey % 7 = 0 then null else c_nationkey = 1 end is_superuser",
    )


def patches(spark: SparkSession, folder: str) -> DataFrame:
    """One change request per customer, made by themselves, a superuser or a stranger."""
    return table(spark, folder, "customer").selectExpr(
        "c_custkey id",
        "case when c_nationkey % 3 = 0 then null else concat('u', cast(c_custkey + c_nationkey % 2 as string), '@',"
        " lower(c_mktsegment), '.example') end email",
        "case when c_nationkey % 2 = 0 then concat('New ', c_name) end full_name",
        "case when c_nationkey % 5 < 3 then c_acctbal < 5000 end is_active",
        "case when c_nationkey % 5 = 1 then true end is_superuser",
        "c_custkey + case when c_nationkey % 6 = 5 then 1 else 0 end actor_id",
        "c_nationkey % 4 = 1 actor_is_superuser",
    )


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Customers outside the HOUSEHOLD segment hold a token."""
    return table(spark, folder, "customer").where("c_mktsegment <> 'HOUSEHOLD'").selectExpr(
        "c_custkey user_id",
        "case when c_mktsegment = 'MACHINERY' then 'google_drive' else 'dropbox' end provider",
        "case when c_mktsegment = 'BUILDING' then null"
        " else timestamp_ntz '2024-01-15 00:00:00' + c_nationkey * interval '6' hour end expires_at",
        "c_acctbal >= 0 has_refresh_token",
        "'files.content.read' scope",
    )


def grants(spark: SparkSession, folder: str) -> DataFrame:
    """A new dropbox grant for every customer with an order, valid as many seconds as orders."""
    orders = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return orders.selectExpr(
        "o_custkey user_id",
        "'dropbox' provider",
        f"timestamp_ntz '{AS_OF}' + n * interval '1' second expires_at",
        "true has_refresh_token",
        "'files.metadata.read' scope",
    )


def task_events(events: DataFrame) -> DataFrame:
    return events.selectExpr(
        "cast(user_id as string) task_id",
        "case when user_id % 2 = 0 then 'nightly_copy' else 'label_batch' end kind",
        "case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running'"
        " when 'purchase' then 'succeeded' else 'failed' end status",
        "ts updated_at",
        "event_id",
    )


def declared_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Document totals, one in ten off by 1.00."""
    return table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("t")
    ).selectExpr("doc_id", "cast(t + case when doc_id % 10 = 0 then 1.00 else 0.00 end as decimal(18,2)) declared_total")


def points(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id id",
        "array(10 * cast(label as double) + 2 * cast(element_at(embedding, 1) as double),"
        " 2 * cast(element_at(embedding, 2) as double)) coords",
    )


def labelled_boxes(spark: SparkSession, folder: str) -> DataFrame:
    return label_detections(numbered_detections(spark, folder))


def corner_columns(name: str, prefix: str) -> list:
    return [F.col(name)[c].alias(f"{prefix}_{c}") for c in ("x0", "y0", "x1", "y1")]


VIEW_SQL = {
    "fx_pages": """
 select doc_id, cast(page_number as int) page_number,
  case when n_chars < 40 then 0.0::double when lang = 'de' then 792.0::double else 612.0::double end width,
  case when n_chars < 40 then 0.0::double when lang = 'de' then 612.0::double else 792.0::double end height,
  cast((doc_id % 4) * 90 as int) rotation
 from (select doc_id, n_chars, lang,
  unnest(range(2 * ((len(string_split(text, chr(10))) + 15) // 16))) page_number from documents)""",
    "fx_blocks": """
 select doc_id, cast(i // 8 as int) page_number, cast(i % 8 as int) block_no, 72.0::double x0,
  36.0::double + 90.0::double * (i % 8) y0, least(72.0::double + 6.0::double * length(line), 700.0::double) x1,
  46.0::double + 90.0::double * (i % 8) y1, line as text
 from (select doc_id, unnest(range(len(string_split(text, chr(10))))) i, unnest(string_split(text, chr(10))) line
  from documents) where length(trim(line)) > 0""",
    "fx_docmeta": """
 select doc_id, case when doc_id % 5 = 0 then null when doc_id % 5 = 1 then '' else concat('Creator  ', source) end creator,
  concat('Title ', cast(doc_id as varchar)) title, lang author, cast(null as varchar) subject,
  case when doc_id % 3 = 0 then concat(lang, ', ', source) end keywords, 'Producer 1.0' producer,
  concat('D:20240', cast(1 + doc_id % 9 as varchar), lpad(cast(1 + doc_id % 28 as varchar), 2, '0'), '103000-05''00''') creation_date,
  case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then concat('2023-0', cast(1 + doc_id % 9 as varchar), '-01')
   else concat('D:20230', cast(1 + doc_id % 9 as varchar), lpad(cast(1 + doc_id % 27 as varchar), 2, '0'), '120000Z') end mod_date,
  'PDF 1.7' format, case when doc_id % 7 = 0 then concat('<< /Size ', cast(doc_id as varchar), ' >>') end trailer
 from documents""",
    "fx_catalogue": """
 select concat('doc/', doc_id) doc_id, concat(source, '/', doc_id) source_path from documents
 union all select concat('web/', page_id), url from pages""",
    "fx_detections": """
 select l_orderkey doc_id, l_linenumber page_number, l_quantity * 10 x1, cast(l_suppkey % 100 as double) * 5 y1,
  l_quantity * 10 + 20 + cast(l_partkey % 50 as double) x2,
  cast(l_suppkey % 100 as double) * 5 + 10 + cast(l_partkey % 30 as double) y2, 1 - l_discount * 5 conf,
  cast(l_partkey % 13 as int) cls
 from lineitem""",
    "fx_labelled": """
 select *, row_number() over (partition by doc_id, page_number order by x1, y1, x2, y2, cls, conf) det_no,
  coalesce(case cls when 0 then 'Caption' when 1 then 'Footnote' when 2 then 'Formula' when 3 then 'List-item'
   when 4 then 'Page-footer' when 5 then 'Page-header' when 6 then 'Picture' when 7 then 'Section-header'
   when 8 then 'Table' when 9 then 'Text' when 10 then 'Title' end, concat('class_', cls)) "label"
 from fx_detections""",
    "fx_files": """
 select id, concat('f', cast(id as varchar), '.', e) "name",
  concat('/', c, '/s%20', s, '/f', cast(id as varchar), '.', e) path, 'file' file_type, e file_ext,
  size, modified_time, source
 from fx_order_files
 union all select distinct -ascii(c), c, concat('/', c), 'folder', null, null, null::timestamp, 'local' from fx_order_files
 union all select distinct -1000 * ascii(c) - ascii(s), concat('s%20', s), concat('/', c, '/s%20', s), 'folder', null, null,
  null::timestamp, 'local' from fx_order_files""",
    "fx_order_files": """
 select o_orderkey id, case when o_orderkey % 5 < 2 then 'pdf' when o_orderkey % 5 = 2 then 'xlsx'
  when o_orderkey % 5 = 3 then 'docx' else 'png' end e, lower(substr(o_orderpriority, 3)) c, o_orderstatus s,
  cast(floor(o_totalprice * 10) as bigint) size, o_orderdate modified_time,
  case when o_custkey % 3 = 0 then 'dropbox' when o_custkey % 3 = 1 then 'google_drive' else 'local' end source
 from orders""",
    "fx_src_listing": """
 select concat('/Docs/C', cast(o_custkey as varchar), '/', n) path_display, n "name", true is_file,
  cast(o_orderkey as varchar) rev, o_orderdate server_modified, cast(floor(o_totalprice) as bigint) size
 from (select *, concat('f', cast(o_orderkey as varchar), case when o_orderkey % 3 = 0 then '.PDF'
  when o_orderkey % 3 = 1 then '.pdf' else '.txt' end) n from orders)
 union all select distinct concat('/Docs/C', cast(o_custkey as varchar)), concat('C', cast(o_custkey as varchar)), false,
  null, null::timestamp, null::bigint from orders""",
    "fx_dst_listing": """
 select concat('in/C', cast(o_custkey as varchar), '/f', cast(o_orderkey as varchar), case when o_orderkey % 3 = 0
  then '.PDF' when o_orderkey % 3 = 1 then '.pdf' else '.txt' end) "key", max(l_shipdate) last_modified
 from lineitem join orders on l_orderkey = o_orderkey where l_returnflag = 'R' group by o_custkey, o_orderkey""",
    "fx_users": """
 select c_custkey id, concat('u', cast(c_custkey as varchar), '@', lower(c_mktsegment), '.example') email,
  case when c_nationkey % 4 = 0 then null else c_name end full_name, c_acctbal >= 0 is_active,
  case when c_nationkey % 7 = 0 then null else c_nationkey = 1 end is_superuser
 from customer""",
    "fx_patches": """
 select c_custkey id, case when c_nationkey % 3 = 0 then null else concat('u', cast(c_custkey + c_nationkey % 2 as varchar),
   '@', lower(c_mktsegment), '.example') end email,
  case when c_nationkey % 2 = 0 then concat('New ', c_name) end full_name,
  case when c_nationkey % 5 < 3 then c_acctbal < 5000 end is_active,
  case when c_nationkey % 5 = 1 then true end is_superuser,
  c_custkey + case when c_nationkey % 6 = 5 then 1 else 0 end actor_id, c_nationkey % 4 = 1 actor_is_superuser
 from customer""",
    "fx_tokens": """
 select c_custkey user_id, case when c_mktsegment = 'MACHINERY' then 'google_drive' else 'dropbox' end provider,
  case when c_mktsegment = 'BUILDING' then null
   else timestamp '2024-01-15 00:00:00' + c_nationkey * interval '6' hour end expires_at,
  c_acctbal >= 0 has_refresh_token, 'files.content.read' scope
 from customer where c_mktsegment <> 'HOUSEHOLD'""",
    "fx_grants": f"""
 select o_custkey user_id, 'dropbox' provider, timestamp '{AS_OF}' + count(*) * interval '1' second expires_at,
  true has_refresh_token, 'files.metadata.read' scope
 from orders group by o_custkey""",
    "fx_task_events": """
 select cast(user_id as varchar) task_id, case when user_id % 2 = 0 then 'nightly_copy' else 'label_batch' end kind,
  case event_type when 'signup' then 'queued' when 'view' then 'running' when 'click' then 'running'
   when 'purchase' then 'succeeded' else 'failed' end status, ts updated_at, event_id
 from events""",
    "fx_statement_totals": """
 select l_orderkey doc_id, cast(sum(cast(l_extendedprice as decimal(18,2)))
  + case when l_orderkey % 10 = 0 then 1.00 else 0.00 end as decimal(18,2)) declared_total
 from lineitem group by l_orderkey""",
    "fx_points": """
 select vec_id id, cast(10 * label as double) + 2 * cast(embedding[1] as double) px,
  2 * cast(embedding[2] as double) py from embeddings""",
}

_NEEDS = {"fx_labelled": ["fx_detections"], "fx_files": ["fx_order_files"]}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """SQL with the named views (and those they need) in front of ``body``."""
    wanted: list[str] = []
    for name in names.split():
        for needed in [*_NEEDS.get(name, []), name]:
            if needed not in wanted:
                wanted.append(needed)
    ctes = ",\n".join(f"{name} as ({VIEW_SQL[name]})" for name in wanted)
    head = "with recursive" if recursive else "with"
    return f"{head} {ctes}\n{body}"
