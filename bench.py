"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quillgrid.plans import registry  # noqa: E402
from quillgrid.session import build_session  # noqa: E402

HEADLINE = (
    "page_profile",
    "document_profile",
    "document_identity",
    "document_validation",
    "metadata_tag",
    "bbox_scalars",
    "box_overlaps",
    "detections_by_label",
    "page_results",
    "table_membership",
    "sync_plan",
    "sync_summary",
    "folder_listing",
    "file_navigation",
    "file_display",
    "breadcrumbs",
    "facet_counts",
    "task_state",
    "token_status",
    "totals_check",
    "semantic_topk",
    "density_clusters",
    "cluster_documents",
    "layout_2d",
    "neighbour_distances",
    "graph_match",
    "trade_triangles",
    "statement_cells",
    "rule_labels",
    "stream_sync",
    "stream_task_state",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        **{
            "spark.master": f"local[{cpus}]",
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    pages_per_second = None
    for name in HEADLINE:
        # The first run loads classes and compiles; the second is measured.
        for _ in range(2):
            start = time.perf_counter()
            df = registry.QUERIES[name](spark, folder)
            df.write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        if name == "page_profile":
            pages_per_second = round(df.count() / seconds[name], 1)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "profiled_pages_per_second": pages_per_second,
            }
        )
    )


if __name__ == "__main__":
    main()
