"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

import json
import os
import sys
import time

from fairlineage.operators import games as G
from fairlineage.operators import shapley as V
from fairlineage.operators.run import totals_of_shapes
from fairlineage.session import build_session, cut
from fairlineage.sources import derived as X
from fairlineage.sources.samples import parquet_dataset

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = build_session(
        f"local[{CPUS}]", int(CPUS), app="bench", spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, make):
        start = time.time()
        result = make()
        result.write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
        return result

    timed("start_up", lambda: G.lineage(parquet_dataset(spark, os.path.join(os.path.dirname(SF), "sf0.001"))))
    timed("join_lineage", lambda: G.lineage(parquet_dataset(spark, SF)))
    timed("distinct_games", lambda: G.tuple_games(G.lineage(parquet_dataset(spark, SF))))
    kept = {}

    def shapes():
        kept["shapes"] = cut(G.tuple_shapes(G.lineage(parquet_dataset(spark, SF)), count_first=True))
        return kept["shapes"]

    timed("shapes", shapes)
    timed("attribution_traditional", lambda: totals_of_shapes(kept["shapes"], "traditional"))
    timed("attribution_permutation_1000", lambda: totals_of_shapes(
        kept["shapes"], "permutation", sample_size=1000))
    timed("attribution_iusv", lambda: totals_of_shapes(kept["shapes"], "iusv"))
    timed("attribution_rdsv", lambda: totals_of_shapes(kept["shapes"], "rdsv"))
    for ablation in ("no-horizontal", "no-vertical", "no-hybrid"):
        timed(f"ablation_{ablation}", lambda: totals_of_shapes(kept["shapes"], "rdsv", ablation=ablation))

    def trade():
        kept["trade"] = cut(G.group_games(X.trade_rows(spark, SF), "c_custkey", X.TRADE_OWNERS))
        return kept["trade"]

    timed("group_games", trade)
    for name, method in (("exhaustive", V.exhaustive), ("combination", V.combination), ("lookup", V.lookup)):
        timed(f"group_{name}", lambda: method(kept["trade"]))
    total = round(sum(v for k, v in seconds.items() if k != "start_up"), 3)
    print(json.dumps({"metric": "attribution_total_seconds", "value": total, "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(SF.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
