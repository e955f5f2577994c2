"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wtel.fixtures import registry, views  # noqa: E402
from wtel.fixtures.compare import session  # noqa: E402
from wtel.sinks.staging import shared_folder  # noqa: E402

HEADLINE = """
    agg1_counter_totals agg4_class_counts src9_parse_du_listing win4_cluster_changes
    win5_app_changes win7_node_app_changes win8_container_changes win1_assign_ids win2_pair_events
    win3_stage_end_times jn3_stage_to_job jn4_attribute_to_query agg11_stage_keys
    agg18_lineage_report pln2_operator_comment sem5_projections sem6_filters arc2_pack_archives
""".split()

# Derived inputs, written once before the clock starts, as a collector would have landed them.
INPUTS = """
    packets query_log du_lines cluster_docs apps_docs node_apps_docs container_docs lifecycle_events
    stages jobs event_lines run_stages plan_ops op_attrs lineage_edges ast_nodes
""".split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    keys = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    registry.QUERIES["agg4_class_counts"](spark, sf_dir).collect()  # start the executors
    folder = f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"
    for name in INPUTS:
        views.land(spark, sf_dir, name, folder)
    times: dict[str, float] = {}
    for key in keys:
        started = time.time()
        registry.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - started, 3)
        print(key, times[key], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")),
                "cpus": cpus,
                "shuffle_partitions": int(spark.conf.get("spark.sql.shuffle.partitions")),
            }
        ),
        flush=True,
    )


if __name__ == "__main__":
    main()
