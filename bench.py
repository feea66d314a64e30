"""Headline queries, timed. Prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dossierflow import catalog  # noqa: E402
from dossierflow.queries import load_all  # noqa: E402
from dossierflow.session import local_session  # noqa: E402

HEADLINE = ["f3_must_have_top3", "g1_rank_listings", "d3_concept_match", "d1_evidence_link", "d9_near_duplicate_lines", "d12_trace_source",
            "e3_text_signature", "e10_scorecard", "l4_shape_rules", "l11_quick_review", "f1_keep_first", "f5_timeline_gaps", "f6_recency_rank",
            "d8_overlapping_intervals", "f14_trailing_rate_flag", "k2_classify_messages", "k3_fold_stage", "k6_admit_requests", "h3_merge_profiles",
            "h6_diff_versions", "b2_html_to_lines", "b7_link_rules", "t2_parse_range"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    load_all()
    names = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # start the session's threads before the first timing
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


main()
