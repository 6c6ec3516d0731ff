"""Table and layout detections: labels, groupings, counts and checks.

Long form has one row per box: ``doc_id, page_number, det_no, x1, y1, x2, y2,
conf, cls``. ``det_no`` is the box's ordinal within its page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quillgrid.functions import geometry as g
from quillgrid.operators.boxes import point_in_box_join
from quillgrid.operators.numbering import Key, with_position
from quillgrid.session import materialise

TABLE = "Table"

# Class labels of the layout model, by class id.
LAYOUT_LABELS = {
    0: "Caption",
    1: "Footnote",
    2: "Formula",
    3: "List-item",
    4: "Page-footer",
    5: "Page-header",
    6: "Picture",
    7: "Section-header",
    8: "Table",
    9: "Text",
    10: "Title",
}

# Known models and what they detect.
MODELS = {
    "keremberke": "YOLOv8‑m: table only",
    "foduucom": "YOLOv8: table only",
    "doclaynet": "YOLOv10‑x on DocLayNet (tables + 10 other classes)",
}
LAYOUT_MODEL = "doclaynet"

DETECTION = T.StructType(
    [T.StructField(n, T.DoubleType()) for n in ("x1", "y1", "x2", "y2", "conf")] + [T.StructField("cls", T.IntegerType())]
)
DETECTION_RESULT = T.StructType(
    [
        T.StructField("boxes", T.ArrayType(DETECTION)),
        T.StructField("image_width", T.IntegerType()),
        T.StructField("image_height", T.IntegerType()),
        T.StructField("status", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


# The status and message of an image that cannot be read.
UNREADABLE, UNREADABLE_MESSAGE = 400, "Could not decode the image bytes."


def available_models(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(MODELS.items()), "model string, description string")


def _known_model(model: str) -> None:
    if model not in MODELS:
        raise ValueError(f"unknown model {model!r}; known: {sorted(MODELS)}")


def class_label(cls: Column, model: str = LAYOUT_MODEL) -> Column:
    """Label of a class id; unknown ids become ``class_<id>``. Other models only find tables."""
    _known_model(model)
    if model != LAYOUT_MODEL:
        return F.lit(TABLE)
    labels = F.create_map(*[F.lit(item) for pair in LAYOUT_LABELS.items() for item in pair])
    return F.coalesce(F.try_element_at(labels, cls), F.concat(F.lit("class_"), cls.cast("string")))


def label_detections(detections: DataFrame, model: str = LAYOUT_MODEL) -> DataFrame:
    """Add ``label`` and ``bbox``."""
    return detections.withColumn("label", class_label(F.col("cls"), model)).withColumn(
        "bbox", g.box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    )


def number_detections(detections: DataFrame, order: Sequence[Key]) -> DataFrame:
    """Give detections that come without an ordinal a ``det_no`` per page."""
    return with_position(detections, ["doc_id", "page_number"], order, position="det_no")


def group_by_label(labelled: DataFrame, chunk: int = 1024) -> DataFrame:
    """Boxes of each page and label as arrays in detection order.

    A page with very many boxes yields several rows per label, told apart by
    ``chunk_no``: no array exceeds ``chunk`` boxes and no box is left out.
    """
    entry = F.struct("det_no", "bbox", "conf")
    grouped = labelled.groupBy(
        "doc_id", "page_number", "label", F.floor((F.col("det_no") - 1) / chunk).cast("int").alias("chunk_no")
    ).agg(F.sort_array(F.collect_list(entry)).alias("__boxes"))
    return grouped.withColumns({"boxes": F.col("__boxes.bbox"), "confs": F.col("__boxes.conf")}).drop("__boxes")


def labelled_array(boxes: Column, model: str = LAYOUT_MODEL) -> Column:
    """Detection array of one image as ``array<struct<label,bbox>>``, order kept; empty for NULL."""
    labelled = F.transform(
        boxes,
        lambda d: F.struct(
            class_label(d["cls"], model).alias("label"), g.box(d["x1"], d["y1"], d["x2"], d["y2"]).alias("bbox")
        ),
    )
    return F.coalesce(labelled, F.array().cast(f"array<struct<label:string,bbox:{g.BOX_TYPE}>>"))


def boxes_of(labelled: Column, label: Column) -> Column:
    return F.transform(F.filter(labelled, lambda d: d["label"] == label), lambda d: d["bbox"])


def page_results(images: DataFrame, model: str = LAYOUT_MODEL) -> DataFrame:
    """The four-part result of every image row: tables by page, tables, other labels, image size.

    Without tables the list is empty; without other labels their map is NULL.
    Works on one row at a time, since a detector returns all boxes of an image
    in one array; nothing is shuffled.
    """
    page, labelled, names = F.col("page_number"), F.col("__labelled"), F.col("__names")
    parts = (
        images.withColumn("__labelled", labelled_array(F.col("boxes"), model))
        .withColumn(
            "__names",
            F.array_distinct(F.transform(F.filter(labelled, lambda d: d["label"] != TABLE), lambda d: d["label"])),
        )
        .withColumn("__tables", boxes_of(labelled, F.lit(TABLE)))
    )
    others = F.map_from_arrays(names, F.transform(names, lambda label: boxes_of(labelled, label)))
    tables = F.col("__tables")
    return parts.select(
        "doc_id",
        "page_number",
        F.create_map(page, tables).alias("coordinates_by_page"),
        F.array(F.create_map(F.lit(TABLE), tables)).alias("table_bboxes"),
        F.create_map(page, F.when(F.size(names) > 0, others)).alias("all_model_bounds"),
        F.create_map(page, F.struct("image_width", "image_height")).alias("page_dimensions"),
    )


def table_counts(labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    return labelled.groupBy(*keys).agg(
        F.count_if(F.col("label") == TABLE).alias("table_count"), F.count(F.lit(1)).alias("box_count")
    )


def out_of_bounds(labelled: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes that are degenerate or leave the image."""
    return labelled.filter(~g.within(F.col("bbox"), width, height))


def minimum_tables(name: Column) -> Column:
    """Expected tables by file name: none for photographed receipts, else one."""
    lowered = F.lower(name)
    return F.when(lowered.contains("receipt") | lowered.contains("phone"), 0).otherwise(1)


def minimum_table_violations(files: DataFrame, counts: DataFrame) -> DataFrame:
    """Files (``doc_id, name``) with fewer tables than their name calls for."""
    return (
        files.join(counts, "doc_id", "left")
        .withColumn("table_count", F.coalesce("table_count", F.lit(0).cast("bigint")))
        .withColumn("minimum", minimum_tables(F.col("name")))
        .filter(F.col("table_count") < F.col("minimum"))
    )


def table_members(blocks: DataFrame, labelled: DataFrame, zoom: float = 1.0, numbered: bool = True) -> DataFrame:
    """Text blocks whose centre lies in a detected table of their page, in reading order.

    ``zoom`` is the render scale of the detected image; boxes are mapped back to
    page units.
    """
    tables = labelled.filter(F.col("label") == TABLE).select(
        "doc_id", "page_number", "det_no", g.scale(F.col("bbox"), 1 / zoom, 1 / zoom).alias("bbox")
    )
    x = g.midpoint(F.col("x0"), F.col("x1"))
    y = g.midpoint(F.col("y0"), F.col("y1"))
    members = point_in_box_join(
        blocks, tables, ["doc_id", "page_number"], x, y, spread=[F.col("block_no")], spread_boxes=[F.col("det_no")]
    )
    if not numbered:
        return members
    order = [F.col("y0"), F.col("x0"), F.col("block_no")]
    members = materialise(members)  # the join runs once
    return with_position(members, ["doc_id", "page_number", "det_no"], order, position="reading_order")


# --- inference hooks -------------------------------------------------------

# What a detector says of an image: rows of x1, y1, x2, y2, conf, cls, then the image's width and height.
Found = tuple[Sequence[Sequence[float]], int, int]
# A batch holds at most so many images, and images of so many bytes.
BATCH_IMAGES = 32
BATCH_BYTES = 64 << 20
# Status of an image on which the model fails.
FAILED = 500


def answered(model: Callable[[list], list], images: list) -> list:
    """The model's result of each image; an exception where it fails on an image alone.

    A batch that fails is halved until the failing images are found, so the others keep their results.
    """
    try:
        found = list(model(images))
        if len(found) != len(images):
            raise ValueError(f"the model returned {len(found)} results for {len(images)} images")
        return found
    except Exception as e:  # reported per image
        if len(images) == 1:
            return [e]
        half = len(images) // 2
        return answered(model, images[:half]) + answered(model, images[half:])


def detect_batches(
    images: DataFrame,
    content: str,
    decode: Callable[[bytes], object | None],
    make_model: Callable[[], Callable[[list], list[Found]]],
    *,
    batch_images: int = BATCH_IMAGES,
    batch_bytes: int = BATCH_BYTES,
    profile: ResourceProfile | None = None,
) -> DataFrame:
    """Run a user's model on a binary column, many images per call; adds the fields of ``DETECTION_RESULT``.

    ``make_model`` runs once per Python task and returns a function from a list
    of decoded images to one result each. A call gets at most ``batch_images``
    images and, unless one alone is larger, ``batch_bytes`` bytes. An image that
    ``decode`` cannot read gives status 400, and one that the model fails on status
    500; neither fails the job. ``profile`` asks for the resources, such as
    GPUs, of the stage that runs the model.
    """
    fields = to_arrow_schema(DETECTION_RESULT)
    names = [*images.columns, *DETECTION_RESULT.names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make_model()
        for batch in batches:
            rows: list[tuple] = [(None, None, None, UNREADABLE, UNREADABLE_MESSAGE)] * batch.num_rows
            held: list[tuple[int, object]] = []
            size = 0

            def flush() -> None:
                if not held:
                    return
                for (i, _), found in zip(held, answered(model, [image for _, image in held])):
                    if isinstance(found, Exception):
                        rows[i] = (None, None, None, FAILED, f"{type(found).__name__}: {found}")
                        continue
                    boxes, image_width, image_height = found
                    kept = [dict(zip(DETECTION.names, (*map(float, b[:5]), int(b[5])), strict=True)) for b in boxes]
                    rows[i] = (kept, image_width, image_height, 200, None)
                held.clear()

            column = batch.column(batch.schema.get_field_index(content))
            for i in range(batch.num_rows):
                data = column[i].as_py()
                image = None if data is None else decode(data)
                if image is None:
                    continue
                if held and (len(held) >= batch_images or size + len(data) > batch_bytes):
                    flush()
                    size = 0
                held.append((i, image))
                size += len(data)
            flush()
            added = [pa.array([r[k] for r in rows], field.type) for k, field in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=names)

    return images.mapInArrow(run, T.StructType([*images.schema.fields, *DETECTION_RESULT.fields]), profile=profile)


def detect(
    images: DataFrame,
    content: str,
    decode: Callable[[bytes], object | None],
    make_detector: Callable[[], Callable[[object], Found]],
) -> DataFrame:
    """As ``detect_batches``, with a detector that takes one image at a time."""

    def make_model() -> Callable[[list], list[Found]]:
        detector = make_detector()
        return lambda batch: [detector(image) for image in batch]

    return detect_batches(images, content, decode, make_model)


def explode_detections(images: DataFrame) -> DataFrame:
    """Long form of ``detect`` output: one row per box, ``det_no`` from 1."""
    kept = [c for c in images.columns if c != "boxes"]
    return images.select(*kept, F.posexplode("boxes").alias("__i", "__box")).select(
        *kept, (F.col("__i") + 1).cast("bigint").alias("det_no"), "__box.*"
    )
