import pytest
from pyspark.sql import functions as F

from quillgrid.operators import detections as det

LONG = "doc_id bigint, page_number int, det_no bigint, x1 double, y1 double, x2 double, y2 double, conf double, cls int"


def image(spark, boxes):
    schema = f"doc_id bigint, page_number int, boxes array<struct<x1:double,y1:double,x2:double,y2:double,conf:double,cls:int>>, image_width int, image_height int"  # noqa: E501
    return spark.createDataFrame([(1, 3, boxes, 640, 480)], schema)


def test_page_result_parts(spark):
    found = [(0.0, 0.0, 1.0, 1.0, 0.9, 9), (1.0, 1.0, 2.0, 2.0, 0.8, 8), (2.0, 2.0, 3.0, 3.0, 0.7, 9), (3.0, 3.0, 4.0, 4.0, 0.6, 12)]
    row = det.page_results(image(spark, found)).first()
    assert [tuple(b) for b in row.coordinates_by_page[3]] == [(1, 1, 2, 2)]
    assert [tuple(b) for b in row.table_bboxes[0]["Table"]] == [(1, 1, 2, 2)]
    others = {k: [tuple(b) for b in v] for k, v in row.all_model_bounds[3].items()}
    assert others == {"Text": [(0, 0, 1, 1), (2, 2, 3, 3)], "class_12": [(3, 3, 4, 4)]}
    assert tuple(row.page_dimensions[3]) == (640, 480)


@pytest.mark.parametrize("found", [[], None])
def test_no_detections(spark, found):
    row = det.page_results(image(spark, found)).first()
    assert row.coordinates_by_page == {3: []} and row.table_bboxes == [{"Table": []}] and row.all_model_bounds == {3: None}


def test_only_non_tables_and_single_class_model(spark):
    found = [(0.0, 0.0, 1.0, 1.0, 0.9, 0)]
    row = det.page_results(image(spark, found)).first()
    assert row.coordinates_by_page == {3: []} and list(row.all_model_bounds[3]) == ["Caption"]
    row = det.page_results(image(spark, found), "keremberke").first()
    assert len(row.coordinates_by_page[3]) == 1 and row.all_model_bounds == {3: None}


def test_unknown_model(spark):
    with pytest.raises(ValueError):
        det.class_label(F.lit(1), "nope")
    assert {r.model for r in det.available_models(spark).collect()} == {"keremberke", "foduucom", "doclaynet"}


def test_large_groups_come_in_chunks(spark):
    rows = [(1, 0, i + 1, float(i), 0.0, float(i + 1), 1.0, 0.5, 8) for i in range(25)]
    grouped = det.group_by_label(det.label_detections(spark.createDataFrame(rows, LONG)), chunk=10).orderBy("chunk_no").collect()
    assert [len(r.boxes) for r in grouped] == [10, 10, 5]
    assert [b.x0 for r in grouped for b in r.boxes] == [float(i) for i in range(25)]
    assert all(r.label == "Table" and len(r.confs) == len(r.boxes) for r in grouped)


def test_policy_by_name(spark):
    files = spark.createDataFrame([(1, "Receipt1.pdf"), (2, "my_PHONE.pdf"), (3, "a.pdf"), (4, "b.pdf")], "doc_id bigint, name string")
    counts = spark.createDataFrame([(3, 1), (4, 0)], "doc_id bigint, table_count bigint")
    assert [r.doc_id for r in det.minimum_table_violations(files, counts).collect()] == [4]


def test_detector_hook(spark):
    images = spark.createDataFrame([(1, 0, bytearray(b"png2")), (2, 0, bytearray(b"not a png")), (3, 0, None), (4, 0, bytearray(b"png0"))], "doc_id bigint, page_number int, content binary")

    def decode(data):
        return data if data.startswith(b"png") else None

    def make():
        return lambda data: ([(i, i, i + 1, i + 1, 0.5, 8) for i in range(data[3] - 48)], 10, 20)

    out = det.detect(images, "content", decode, make)
    got = {r.doc_id: (r.status, r.error, None if r.boxes is None else len(r.boxes)) for r in out.collect()}
    bad = (400, "Could not decode the image bytes.", None)
    assert got == {1: (200, None, 2), 2: bad, 3: bad, 4: (200, None, 0)}
    rows = det.explode_detections(out).orderBy("det_no").collect()
    assert [(r.doc_id, r.det_no, r.x2) for r in rows] == [(1, 1, 1.0), (1, 2, 2.0)]


def test_bounds(spark):
    rows = [(1, 0, 1, 0.0, 0.0, 5.0, 5.0, 0.5, 8), (1, 0, 2, 0.0, 0.0, 6.0, 5.0, 0.5, 8), (1, 0, 3, 2.0, 0.0, 2.0, 5.0, 0.5, 8)]
    labelled = det.label_detections(spark.createDataFrame(rows, LONG))
    assert sorted(r.det_no for r in det.out_of_bounds(labelled, F.lit(5.0), F.lit(5.0)).collect()) == [2, 3]


def test_batches_and_failing_images(spark):
    sizes = spark.sparkContext.accumulator(0)
    calls = spark.sparkContext.accumulator(0)

    def make():
        def model(images):
            calls.add(1)
            sizes.add(len(images))
            if any(image == b"bad" for image in images):
                raise ValueError("no tensor")
            return [([], len(image), 1) for image in images]

        return model

    rows = [(i, bytearray(b"bad" if i == 37 else b"x" * (i % 5 + 1)), "kept") for i in range(100)] + [(100, None, "kept")]
    images = spark.createDataFrame(rows, "id int, content binary, note string").coalesce(1)
    out = det.detect_batches(images, "content", lambda d: d, make, batch_images=25).collect()
    assert {r.id: (r.status, r.image_width) for r in out} == {
        **{i: (200, i % 5 + 1) for i in range(100) if i != 37}, 37: (500, None), 100: (400, None)
    }
    assert {r.error for r in out if r.status == 500} == {"ValueError: no tensor"} and {r.note for r in out} == {"kept"}
    # Four calls for a hundred images; the failing one is found by halving its batch.
    assert calls.value <= 4 + 2 * 5 and sizes.value < 200
    large = spark.createDataFrame([(i, bytearray(b"x" * 40)) for i in range(10)], "id int, content binary").coalesce(1)
    before = calls.value
    assert det.detect_batches(large, "content", lambda d: d, make, batch_bytes=100).filter("status = 200").count() == 10
    assert calls.value - before == 5


def test_a_model_must_answer_every_image(spark):
    images = spark.createDataFrame([(1, bytearray(b"a"))], "id int, content binary")
    out = det.detect_batches(images, "content", lambda d: d, lambda: lambda batch: []).collect()
    assert [(r.status, r.error) for r in out] == [(500, "ValueError: the model returned 0 results for 1 images")]
