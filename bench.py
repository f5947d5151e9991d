"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelspark.operators.steady import steady_state  # noqa: E402
from panelspark.registry import QUERIES  # noqa: E402
from panelspark.registry.base import params  # noqa: E402
from panelspark.session import build_session  # noqa: E402

HEADLINE = [
    "annualised_growth", "observables", "align_sources", "first_match", "asof_interpolate", "rolling_sum_rows",
    "rolling_sum_calendar", "sample_split", "posterior_summary", "posterior_quantiles", "rhat_split", "rhat_rank",
    "effective_sample_size", "posterior_report", "param_correlation", "pair_hist2d", "density", "trace", "compare_runs",
    "log_prior", "fevd_horizons", "group_contributions", "shock_convolution", "irf_bands", "var1_ols",
    "steady_state", "calibrate_b0", "counterfactual_table", "welfare_ecv", "posterior_functional", "sweep", "laffer_peak",
]
WARM_UP = ["annualised_growth", "rhat_split", "steady_state"]


def run(df) -> float:
    start = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - start


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    for name in WARM_UP:    # start the engine and its Python workers; not timed
        run(QUERIES[name](spark, sf))
    times = {}
    for name in HEADLINE:
        start = time.time()
        run(QUERIES[name](spark, sf))
        times[name] = round(time.time() - start, 3)
    rows = params(spark, sf).repartition(int(cpus)).selectExpr("*", "explode(sequence(1, 50)) as copy")
    n = rows.count()
    rate = n / run(steady_state(rows))
    print(json.dumps({
        "metric": "total wall time of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus), "warm_up": WARM_UP,
        "steady_state_rows_per_sec": round(rate)}))


if __name__ == "__main__":
    main()
