"""Documents: identity, validation, page geometry and profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgrid.functions import geometry as g
from quillgrid.functions import metadata as m
from quillgrid.operators.numbering import batch_number

PAGE_KEY = ["doc_id", "page_number"]


def with_identity(df: DataFrame, path: str, content: str, source_type: str = "local") -> DataFrame:
    """Add ``id``, ``content_hash`` and ``source_type``.

    The hash is that of the stored bytes, however the document was loaded.
    """
    return df.withColumns(
        {
            "id": m.document_id(F.col(path)),
            "content_hash": m.sha256_hex(F.col(content)),
            "source_type": F.lit(source_type),
        }
    )


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("page_count"))


def validate_documents(
    documents: DataFrame, pages: DataFrame, blocks: DataFrame | None = None, path: str = "source_path"
) -> DataFrame:
    """Add ``page_count`` and ``error struct<code,message>`` (NULL for a sound document).

    Only the first page's size counts. The no-text check runs if ``blocks`` is
    given.
    """
    first = F.col("page_number") == 0
    shape = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("page_count"),
        F.max(F.when(first, (F.col("width") == 0) | (F.col("height") == 0))).alias("__flat"),
    )
    checked = documents.join(shape, "doc_id", "left").withColumn(
        "page_count", F.coalesce("page_count", F.lit(0).cast("bigint"))
    )
    code = F.when(F.col("page_count") == 0, "NO_PAGES").when(F.col("__flat"), "NO_SIZE")
    if blocks is not None:
        texts = blocks.groupBy("doc_id").agg(F.lit(True).alias("__text"))
        checked = checked.join(texts, "doc_id", "left")
        code = code.when(F.col("__text").isNull(), "NO_TEXT")
    name = F.coalesce(m.present(F.col(path)), F.lit("<bytes>"))
    problem = (
        F.when(F.col("__code") == "NO_PAGES", "has no pages.")
        .when(F.col("__code") == "NO_SIZE", "has a page with no width or height.")
        .otherwise("has a page with no text.")
    )
    message = F.concat(F.lit("PDF '"), name, F.lit("' "), problem)
    checked = checked.withColumn("__code", code)
    error = F.when(
        F.col("__code").isNotNull(), F.struct(F.col("__code").alias("code"), message.alias("message"))
    )
    return checked.withColumn("error", error).select(*documents.columns, "page_count", "error")


def project_pages(pages: DataFrame) -> DataFrame:
    return pages.select(
        *PAGE_KEY,
        F.col("width").cast("double").alias("width"),
        F.col("height").cast("double").alias("height"),
        F.coalesce(F.col("rotation"), F.lit(0)).cast("int").alias("rotation"),
    )


def head_pages(pages: DataFrame, limit: int = 5) -> DataFrame:
    """First ``limit`` pages of every document. Page numbers are dense from 0, so this is a filter."""
    return pages.filter(F.col("page_number") < max(limit, 0))


def slice_pages(pages: DataFrame, start: int = 0, stop: int | None = None) -> DataFrame:
    kept = pages.filter(F.col("page_number") >= max(start, 0))
    return kept if stop is None else kept.filter(F.col("page_number") < stop)


def batch_pages(pages: DataFrame, size: int) -> DataFrame:
    return pages.withColumn("batch", batch_number(F.col("page_number"), size))


def content_frames(blocks: DataFrame) -> DataFrame:
    """One row per page with blocks: the box around all non-degenerate blocks, and the block count."""
    solid = (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0"))

    def edge(fold, name: str) -> Column:
        return F.coalesce(fold(F.when(solid, F.col(name))), F.lit(0.0))

    return blocks.groupBy(*PAGE_KEY).agg(
        g.box(edge(F.min, "x0"), edge(F.min, "y0"), edge(F.max, "x1"), edge(F.max, "y1")).alias("content_frame"),
        F.count(F.lit(1)).alias("block_count"),
    )


def page_metadata(pages: DataFrame, blocks: DataFrame, clamp_nonnegative: bool = True) -> DataFrame:
    """Page fields with text presence, content frame, outside strips and margins.

    Pages without blocks stay, with an all-zero frame. Optional page columns
    ``origin_x`` and ``origin_y`` move the page rectangle off the origin.
    """
    zero = F.lit(0.0)
    x = F.col("origin_x") if "origin_x" in pages.columns else zero
    y = F.col("origin_y") if "origin_y" in pages.columns else zero
    rect = g.box(x, y, x + F.col("width"), y + F.col("height"))
    joined = (
        pages.withColumn("__page", rect)
        .join(content_frames(blocks), PAGE_KEY, "left")
        .withColumn("content_frame", F.coalesce("content_frame", g.box(0.0, 0.0, 0.0, 0.0)))
        .withColumn("block_count", F.coalesce("block_count", F.lit(0).cast("bigint")))
    )
    frame, page = F.col("content_frame"), F.col("__page")
    return joined.select(
        *PAGE_KEY,
        "width",
        "height",
        F.coalesce(F.col("rotation"), F.lit(0)).alias("rotation"),
        (F.col("block_count") > 0).alias("has_text"),
        "block_count",
        "content_frame",
        g.inverse_rects(frame, page).alias("inverse_rects"),
        g.margins(frame, page, clamp_nonnegative).alias("margins"),
    )


def document_metadata(docs: DataFrame, accessors: Sequence[str] = m.ACCESSORS) -> DataFrame:
    """``doc_id`` and a ``document`` struct: non-empty fields, tag, raw map, trailer, format, dates."""
    fields = [m.present(F.col(a)).alias(a) for a in accessors]
    trailer = F.col("trailer") if "trailer" in docs.columns else F.lit(None).cast("string")
    raw_fields = (*accessors, *m.DATE_FIELDS.values(), "format")
    return docs.select(
        "doc_id",
        F.struct(
            *fields,
            m.metadata_tag(tuple(accessors)).alias("tag"),
            m.raw_metadata(raw_fields).alias("raw"),
            trailer.alias("trailer"),
            F.col("format"),
            m.document_dates().alias("dates"),
        ).alias("document"),
    )


def document_profiles(docs: DataFrame, pages: DataFrame, blocks: DataFrame, limit: int = 5) -> DataFrame:
    """One row per document: its metadata and the first ``limit`` pages' metadata, in page order.

    Pages and blocks are cut to the limit before any join, so a group never
    collects more than ``limit`` rows.
    """
    metas = page_metadata(head_pages(pages, limit), head_pages(blocks, limit))
    fields = [c for c in metas.columns if c != "doc_id"]
    packed = metas.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("pages"))
    return (
        document_metadata(docs)
        .join(packed, "doc_id", "left")
        .withColumn("pages", F.coalesce("pages", F.expr(f"cast(array() as {packed.schema['pages'].dataType.simpleString()})")))
    )
