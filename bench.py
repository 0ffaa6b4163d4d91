"""Times registered queries and prints one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from formulary.plans.catalog import QUERIES
from formulary.session import local_session

HEADLINE = [
    "scorecard",
    "scorecard_with_parse",
    "verdicts",
    "match_predicates",
    "predicate_matches",
    "predicate_inventory",
    "route_prompts",
    "seq2seq_prompt_given_preds",
    "chat_train",
    "prompt_noisy_preds",
    "noise_rows",
    "assign_batches",
    "pending",
    "combine_corpora_dedup",
    "vocab_build",
    "encode",
    "encode_by_join",
    "decode",
    "batch_pad",
    "pad_truncate",
    "premise_context",
    "running_chat_context",
    "best_epoch",
    "early_stop",
    "parse_nodes",
    "formula_profile",
    "export_prover_text",
    "generate",
    "generate_sequential",
    "call_with_retry",
    "write_predictions",
    "stream_predictions",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    for name in names:  # one warm-up run each
        run(name)
    times = {name: round(run(name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
