"""Wall seconds per headline query, each run to a ``noop`` sink. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promptsieve.plans import catalog
from promptsieve.session import build_session

HEADLINE = [
    "q_normalize", "q_tokens_word", "q_consolidate", "q_source_stats", "q_exact_dedup", "q_exact_sample", "q_split",
    "q_augment_train", "q_codec_homoglyph", "q_codec_base64", "q_template_prompts", "q_vocab_word", "q_vocab_char",
    "q_encode", "q_tfidf_word", "q_tfidf_char", "q_max_similarity", "q_similarity_filter", "q_similarity_prune",
    "q_novel_set", "q_macro_metrics", "q_class_report", "q_compare", "q_token_importance",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.format("noop").mode("overwrite").save()  # JVM warm-up
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_wall_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
