"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import sys
import time

HEADLINE = [
    "phased_windows",
    "phased_segments",
    "fetch_region",
    "interval_overlap_join",
    "base_composition",
    "target_search_join",
    "structure_feature_table",
    "hairpin_check",
    "quantile_transform",
    "feature_evaluation_table",
    "top6_recommendations",
    "localize_batch",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = os.environ.get("BENCH_QUERIES")
    names = only.split(",") if only else HEADLINE
    with contextlib.redirect_stdout(sys.stderr):
        sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
        from phasegrid import catalog
        from phasegrid.session import local_session

        spark = local_session(cpus, "16g", "phasegrid-bench")
        times: dict[str, float] = {}
        for name in names:
            start = time.time()
            result = catalog.run_query(catalog.QUERIES[name], spark, folder)
            result.write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 2)
            print(name, times[name], file=sys.stderr, flush=True)
        spark.stop()
    line = {
        "metric": "total wall time of the headline queries",
        "value": round(sum(times.values()), 2),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
