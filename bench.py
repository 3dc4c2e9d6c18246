"""Time the headline queries: one JSON line on standard output."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusloom.session import get_session  # noqa: E402
from corpusloom.workload import derive, load, sources  # noqa: E402

HEADLINE = (
    "wordpunct", "labelled_split_ratio", "drop_ambiguous", "stratified_split", "control_labels",
    "match_field_regex", "pair_deprel", "pattern_triangle", "pattern_path", "filter_sentences",
    "multi_class_task", "build_filter_task", "token_tree_paths", "top_category_token",
    "classify_by_pos", "category_inventory", "build_ud_tasks", "corpus_union", "corpus_blocks",
    "task_sink_roundtrip", "encode_distinct", "pool_avg", "metric_report", "results_pivot",
    "encode_layers", "probe_logreg", "run_probe", "ud_task_report",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    })
    queries, _ = load()
    times: dict[str, float] = {}

    def clock(name: str, run) -> None:
        start = time.time()
        run()
        times[name] = round(time.time() - start, 3)

    # parsing and annotating happens once per corpus; later queries read the stored sentences
    clock("ingest_sentences", lambda: derive.sentences(spark, folder).count())
    clock("write_conllu", lambda: sources.treebank_path(spark, folder))
    for name in HEADLINE:
        clock(name, lambda: queries[name](spark, folder).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times,
                      "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
