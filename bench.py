"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and print one JSON line.

Each query runs once to warm up and then three times; the median is reported. The action writes every row
and column to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "Q01_units_over_limit_now", "Q02_units_over_limit_24h", "Q03_lowest_intensity", "Q04_monthly_trend_of_coal", "Q05_month_summary",
    "Q06_daily_load_by_type", "Q10_unit_table", "Q12_exceedance_counts_30d", "Q15_status_board", "Q16_paged_listing", "Q23_intensity_by_unit",
    "J02_fact_to_fact", "J05_join_on_day", "A03_distinct_counts", "A08_statistics_by_day", "A11_median_and_mode", "A12_correlation_matrix",
    "A13_box_summary", "W01_rolling", "W02_rolling_shifted", "W08_targets", "W10_weighted_mean", "W11_quartile_level", "W14_interpolate",
    "D01_clean_series", "D02_clean_table", "D10_standard_scaling", "E01_sliding_features", "E05_top_frequencies", "E08_merge_by_date",
    "E11_history_features", "M01_random_split", "M02_chronological_split", "M07_metrics", "M09_ensemble", "T03_keywords", "T04_classify",
    "T08_similarity_search", "T12_error_rates", "O04_request_metrics", "S11_upsert",
)


def main() -> None:
    from plantlens.plans.queries import QUERIES
    from plantlens.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if i:
                taken.append(time.perf_counter() - t0)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
