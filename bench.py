"""Times the registered queries and prints one line of JSON.

BENCH_SF_DIR and BENCH_CPUS choose data and cores, BENCH_QUERIES a comma-separated
selection. Queries that only look at a fit that another one makes are left out. Each query is planned and run in full into a sink that discards rows.
An untimed pass goes first, so that compilation inside the JVM is not what is
measured; queries that fit models go without one.
"""

import json
import os
import time

from areaframe.queries import QUERIES
from areaframe.session import get_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TRAINED = ("boosted_trees", "neural_net", "train_evaluate")
SAME_FIT = ("boosted_trees_rows", "neural_net_rows")


def run(spark, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = get_session(
        "bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else [name for name in QUERIES if name not in SAME_FIT]
    for name in names:
        if name not in TRAINED:
            run(spark, name)
    times = {name: round(run(spark, name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(os.path.normpath(FOLDER)),
            }
        )
    )


if __name__ == "__main__":
    main()
