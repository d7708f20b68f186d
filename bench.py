"""Times the headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON: the median of the runs after a first one (a run of over 15 s isn't repeated)."""

import importlib.util
import json
import os
import statistics
import sys
import time

HEADLINE = (
    "qc_max_ee qc_report qc_paired derep_uniques derep_quals derep_pool seq_table_long seq_table_pivot quality_profile fn_kmer_dist seq_complexity phix_overlapping pair_merge_gapless chimera_vote "
    "trans_counts_gapless denoise tax_kmer_train tax_species_exact tax_classify p1_found p2_found p3_found p4_found p5_found p6_found p7_found p8_windows p9_found p10_found"
).split()


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    here = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, here)
    spec = importlib.util.spec_from_file_location("entry", f"{here}/__spark_entry__.py")
    entry = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(entry)
    known = entry.queries()
    wanted = sys.argv[1:] or [q for q in HEADLINE if q in known]
    seconds = {}
    for name in wanted:
        took = []
        for _ in range(runs):
            began = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
            print(f"{name} {took[-1]:.2f}", file=sys.stderr, flush=True)
            if took[-1] > 15:
                break
        seconds[name] = round(statistics.median(took[1:] or took), 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
