"""Wall time of the headline queries on one machine.

Reads ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]`` and prints one JSON line. Every
result is consumed whole (``noop`` sink), so no column is pruned away.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from inkmirror.plans.queries import QUERIES  # noqa: E402
from inkmirror.session import local_session  # noqa: E402

HEADLINE = [
    "sync_report",
    "decide_action",
    "sync_fold",
    "quota_cut",
    "index_upsert",
    "index_json_roundtrip",
    "paged_notes",
    "classify_outcome",
    "resolve_requests",
    "pacing_audit",
    "tree_paths",
    "folder_set",
    "unique_names",
    "write_plan",
    "sanitize_names",
    "timestamps",
    "frontmatter_build",
    "frontmatter_merge",
    "body_splice",
    "text_clean",
    "page_clean",
    "paragraphs",
    "note_bodies",
    "article_route",
    "html_to_markdown",
    "image_rewrite",
    "attachments_new",
    "notes_sync",
    "run_report",
    "stream_state",
    "stream_fold",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8)
    wanted = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()  # start the session before the clock
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
