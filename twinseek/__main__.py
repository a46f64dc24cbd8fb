"""Command line: `python -m twinseek JOB --help`, of signatures, detect, retrieve, exact, evaluate and validate."""

from __future__ import annotations

import argparse
import importlib
import logging

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from twinseek.operators import evaluate, match, validate
from twinseek.plans import detection, retrieval
from twinseek.sources import readers, sinks

SIGNED = "sig_id string, sv array<string>, sp array<string>, fo array<string>, fd array<string>, n_ev int, n_dv int, n_fv int, n_ep int, n_dp int, introduced boolean, processing_status string"


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="twinseek")
    jobs = parser.add_subparsers(dest="job", required=True)
    sign = jobs.add_parser("signatures", help="JSON lines of flaws and fixes to signatures")
    sign.add_argument("pairs")
    sign.add_argument("out")
    sign.add_argument("--introducing")
    find = jobs.add_parser("detect", help="functions that match signatures")
    find.add_argument("signatures")
    find.add_argument("functions", help="a directory of JSON arrays of {path, function}")
    find.add_argument("out")
    find.add_argument("--threshold", type=float, default=0.5)
    near = jobs.add_parser("retrieve", help="functions that are alike flaws, by vectors")
    same = jobs.add_parser("exact", help="functions that are copies of flaws, by hash")
    for job in (near, same):
        job.add_argument("corpus", help="JSON lines of flaws")
        job.add_argument("functions", help="a directory of JSON arrays of {path, function}")
        job.add_argument("out")
    near.add_argument("--work", required=True, help="a shared folder for vectors")
    near.add_argument("--top_k", type=int, default=1)
    near.add_argument("--threshold", type=float, default=0.5)
    near.add_argument("--batch_size", type=int, default=4)
    near.add_argument("--disable_filtering", action="store_true")
    near.add_argument("--use_abstraction", action="store_true", default=True)
    near.add_argument("--no_abstraction", action="store_true")
    near.add_argument("--log_file")
    near.add_argument("--again", action="store_true", help="also repositories that have an output")
    ask = jobs.add_parser("validate", help="verdicts of an outside model on clones")
    ask.add_argument("--results", required=True, help="the output of retrieve")
    ask.add_argument("--sources", required=True, help="JSON lines of flaws")
    ask.add_argument("--output", required=True)
    ask.add_argument("--client", required=True, help="module:function that takes a prompt and gives a reply")
    ask.add_argument("--delay", type=float, default=1.0)
    ask.add_argument("--limit", type=int)
    ask.add_argument("--responses-dir")
    score = jobs.add_parser("evaluate", help="counts and ratios of labelled entries")
    score.add_argument("entries")
    score.add_argument("-o", "--out", required=True)
    asked = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("twinseek").getOrCreate()
    if asked.job == "signatures":
        sinks.write_lines(detection.signatures(detection.pairs(spark, asked.pairs, asked.introducing)), asked.out)
        return
    if asked.job == "evaluate":
        found = retrieval.evaluated(spark, asked.entries)
        sinks.write_lines(found, asked.out)
        sinks.report(found).show()
        return
    if asked.job == "validate":
        module, _, name = asked.client.partition(":")
        client = getattr(importlib.import_module(module), name)
        found = retrieval.judged(spark.read.parquet(asked.results), readers.corpus(spark, asked.sources, tolerant=True), client, asked.limit, asked.delay)
        found.write.mode("overwrite").parquet(asked.output)  # each clone is asked about once, whatever reads the verdicts
        found = spark.read.parquet(asked.output)
        if asked.responses_dir:
            validate.write_artefacts(found, asked.responses_dir)
        evaluate.verdicts(found).show()
        return
    if asked.job == "retrieve":
        if asked.log_file:
            logging.basicConfig(filename=asked.log_file, level=logging.INFO, format="%(asctime)s - %(message)s")
        corpus, functions = readers.corpus(spark, asked.corpus), readers.functions(spark, asked.functions)
        done = None if asked.again else sinks.written(spark, asked.out)
        if done is not None:
            functions = match.unprocessed(functions, done, "repo")
        logging.info("repositories with an output: %s", "none" if done is None else done.count())
        found = retrieval.retrieve(corpus, functions, asked.work, k=asked.top_k, threshold=asked.threshold, filtering=not asked.disable_filtering, abstract=not asked.no_abstraction, batch=asked.batch_size)
        sinks.write_results(found, asked.out)
        return
    if asked.job == "exact":
        known = readers.numbered_lines(spark, asked.corpus, "func string, commit_url string, cve string").withColumn("ord", F.struct("file", "line_number"))
        sinks.write_lines(retrieval.exact(known, readers.functions(spark, asked.functions, "*_functions.json"), "ord"), asked.out, ("_metadata",))
        return
    functions = readers.functions(spark, asked.functions).withColumn("target_id", F.sha2(F.concat_ws("\n", "json_file", "path", "function"), 256))
    found = detection.detect(readers.signatures(spark, asked.signatures, SIGNED), detection.targets_of(functions), asked.threshold)
    sinks.write_lines(found.join(functions.select("target_id", "repo", "path").distinct(), "target_id"), asked.out)


if __name__ == "__main__":
    main()
