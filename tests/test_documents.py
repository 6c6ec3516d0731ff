from pyspark.sql import functions as F

from quillgrid.operators import documents as d

PAGES = "doc_id bigint, page_number int, width double, height double, rotation int"
BLOCKS = "doc_id bigint, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"


def test_validation_codes(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, ""), (5, None)], "doc_id bigint, source_path string")
    pages = spark.createDataFrame(
        [(2, 0, 0.0, 5.0, 0), (3, 0, 5.0, 0.0, 0), (4, 0, 5.0, 5.0, 0), (4, 1, 0.0, 5.0, 0)], PAGES
    )
    got = {r.doc_id: (r.page_count, r.error and tuple(r.error)) for r in d.validate_documents(docs, pages).collect()}
    assert got == {
        1: (0, ("NO_PAGES", "PDF 'a' has no pages.")),
        2: (1, ("NO_SIZE", "PDF 'b' has a page with no width or height.")),
        3: (1, ("NO_SIZE", "PDF 'c' has a page with no width or height.")),
        4: (2, None),
        5: (0, ("NO_PAGES", "PDF '<bytes>' has no pages.")),
    }


def test_no_text_check_is_optional(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, source_path string")
    pages = spark.createDataFrame([(1, 0, 5.0, 5.0, 0), (2, 0, 5.0, 5.0, 0)], PAGES)
    blocks = spark.createDataFrame([(1, 0, 0, 0.0, 0.0, 1.0, 1.0, "x")], BLOCKS)
    got = {r.doc_id: r.error and r.error.code for r in d.validate_documents(docs, pages, blocks).collect()}
    assert got == {1: None, 2: "NO_TEXT"}


def test_frame_ignores_degenerate_blocks_but_counts_them(spark):
    pages = spark.createDataFrame([(1, 0, 100.0, 100.0, None), (1, 1, 100.0, 100.0, 90), (1, 2, 100.0, 100.0, 0)], PAGES)
    blocks = spark.createDataFrame(
        [(1, 0, 0, 10.0, 10.0, 20.0, 20.0, "a"), (1, 0, 1, 1.0, 1.0, 1.0, 50.0, "b"), (1, 2, 0, 5.0, 5.0, 5.0, 5.0, "c")], BLOCKS
    )
    got = {r.page_number: r for r in d.page_metadata(pages, blocks).collect()}
    assert tuple(got[0].content_frame) == (10, 10, 20, 20) and got[0].block_count == 2 and got[0].rotation == 0
    assert tuple(got[1].content_frame) == (0, 0, 0, 0) and not got[1].has_text and got[1].block_count == 0
    assert tuple(got[2].content_frame) == (0, 0, 0, 0) and got[2].has_text
    assert tuple(got[0].margins) == (10, 80, 10, 80)


def test_page_origin(spark):
    pages = spark.createDataFrame([(1, 0, 10.0, 10.0, 0, 5.0, 5.0)], PAGES + ", origin_x double, origin_y double")
    blocks = spark.createDataFrame([(1, 0, 0, 6.0, 7.0, 9.0, 9.0, "a")], BLOCKS)
    assert tuple(d.page_metadata(pages, blocks).first().margins) == (1, 6, 2, 6)


def test_limits_and_slices(spark):
    pages = spark.createDataFrame([(1, i, 1.0, 1.0, 0) for i in range(7)] + [(2, 0, 1.0, 1.0, 0)], PAGES)
    count = lambda df: {r.doc_id: r["count"] for r in df.groupBy("doc_id").count().collect()}
    assert count(d.head_pages(pages)) == {1: 5, 2: 1}
    assert count(d.head_pages(pages, 0)) == count(d.head_pages(pages, -1)) == {}
    assert count(d.head_pages(pages, 100)) == {1: 7, 2: 1}
    assert count(d.slice_pages(pages, 2, 4)) == {1: 2}
    assert count(d.slice_pages(pages, 4, 4)) == count(d.slice_pages(pages, 5, 2)) == {}
    assert count(d.slice_pages(pages, -3, None)) == {1: 7, 2: 1}
    assert [r.batch for r in d.batch_pages(pages, 3).filter("doc_id = 1").orderBy("page_number").collect()] == [0, 0, 0, 1, 1, 1, 2]


def test_profile_shape(spark):
    docs = spark.createDataFrame(
        [(1, "c", "", "D:20240102", "bad", "PDF"), (2, None, "t", None, None, None)],
        "doc_id bigint, creator string, title string, creation_date string, mod_date string, format string",
    )
    pages = spark.createDataFrame([(1, i, 1.0, 2.0, 0) for i in (3, 1, 0, 2)], PAGES)
    blocks = spark.createDataFrame([], BLOCKS)
    accessors = ("creator", "title")
    meta = {r.doc_id: r.document for r in d.document_metadata(docs, accessors).collect()}
    assert meta[1].title is None and meta[1].tag == "creator|c" and list(meta[1].dates) == ["creationDate"]
    assert meta[1].raw == {"creator": "c", "creation_date": "D:20240102", "mod_date": "bad", "format": "PDF"}
    full = docs.withColumns({a: F.lit(None).cast("string") for a in ("author", "subject", "keywords", "producer")})
    got = {r.doc_id: r for r in d.document_profiles(full, pages, blocks, limit=3).collect()}
    assert [p.page_number for p in got[1].pages] == [0, 1, 2] and got[2].pages == []
