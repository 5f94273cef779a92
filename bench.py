"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose tables and
cores. Every query is written to a sink that drops rows, so all of it is computed. The
session is warmed with one small query. A query runs once, and twice more if that took less than
AGAIN seconds; the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from colloquy.operators import vocabulary
from colloquy.plans import catalog
from colloquy.plans.registry import Tables
from colloquy.session import build_session

HEADLINE = [
    "clean_utterance", "filter_two_speakers", "render_prompt", "normalize_source",
    "split_answer", "render_by_source", "keep_source_file", "trigger_cascade", "split_message",
    "exact_dedup", "split_leak_check", "corpus_stats", "pretoken_counts", "mean_loss_perplexity",
    "repetition_stats", "latency_percentiles", "follow_rate", "asof_last_state", "rolling_p99",
    "pack_blocks", "pack_stream", "weighted_interleave", "cap_per_group", "token_budget_cut",
    "identity_split", "topk_filter", "lm_score", "mmi_rerank", "naive_bayes_counts",
    "synth_template_messages", "labelled_corpus", "stream_room_history", "stream_session_stats",
    "bpe_learn", "bpe_encode", "train_text_classifier", "trace_corpus_whole", "dialogue_corpus_stats",
    "write_token_shards", "crop_windows",
]
FOLDER_KEY = "BENCH_SHARED_DIR"  # scratch tables and checkpoints; by default a folder that is removed


AGAIN = 5.0


def median_of(run) -> float:
    first = timed(run)
    return first if first >= AGAIN else sorted([first, timed(run), timed(run)])[1]


def timed(run) -> float:
    start = time.time()
    run().write.format("noop").mode("overwrite").save()
    return round(time.time() - start, 3)


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="colloquy-bench-") as own:
        run_all(os.environ.get(FOLDER_KEY, own))


def run_all(shared: str) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.checkpoint.dir": shared})
    spark.sparkContext.setLogLevel("ERROR")
    tables = Tables(spark, folder)
    timed(lambda: catalog.PLANS["hash_split"](spark, folder))

    seconds = {name: median_of(lambda n=name: catalog.PLANS[n](spark, folder)) for name in HEADLINE}

    # Text to token ids, the one rate that has a published counterpart, with as many merges.
    merges = vocabulary.bpe_learn(tables.conversations, "text")
    start = time.time()
    ids = vocabulary.bpe_encode(tables.documents, ["doc_id"], vocabulary.special_pieces(F.col("text"), []), merges, [])
    tokens = ids.select(F.size("ids").alias("n")).agg(F.sum("n")).first()[0]
    rate = round(tokens / (time.time() - start))

    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "tokens_encoded": tokens, "tokens_per_sec": rate}))
    spark.stop()


if __name__ == "__main__":
    main()
