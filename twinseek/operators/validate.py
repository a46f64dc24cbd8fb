"""Verdicts by an outside model: prompts, an injected client, repair and typed parsing of replies."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinseek.functions.text import clean_json, prompt

VERDICT = "is_vulnerable boolean, confidence_level int, justification string"


def ask(clones: DataFrame, client: Callable[[str], str], delay: float = 0.0) -> DataFrame:
    """Adds raw_response and error to clones (vuln, fix, clone); one call for each row, `delay` seconds apart in a task."""
    rows = clones.withColumn("prompt", prompt(F.col("vuln"), F.col("fix"), F.col("clone")))
    names = rows.columns

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            raw, error = [], []
            for text in batch["prompt"]:
                try:
                    raw.append(client(text))
                    error.append(None)
                except Exception as e:  # noqa: BLE001
                    raw.append(None)
                    error.append(str(e))
                time.sleep(delay)
            yield batch.assign(raw_response=raw, error=error)

    kinds = dict(rows.dtypes)
    return rows.mapInPandas(run, ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", raw_response string, error string")


def write_artefacts(verdicts: DataFrame, path: str) -> None:
    """Raw replies, parsed verdicts and errors, each with the flaw and the clone, as JSON lines in folders of their own."""
    pair = ["vuln", "clone"]
    verdicts.filter("raw_response is not null").select(*pair, "raw_response").write.mode("overwrite").json(f"{path}/raw")
    verdicts.filter("error is null").select(*pair, "is_vulnerable", "confidence_level", "justification").write.mode("overwrite").json(f"{path}/parsed")
    verdicts.filter("error is not null").select(*pair, "error", "raw_response").write.mode("overwrite").json(f"{path}/errors")


def parse(replies: DataFrame) -> DataFrame:
    """cleaned_json, the verdict's fields, and error where there is no object."""
    rows = replies.withColumn("cleaned_json", clean_json(F.col("raw_response"))).withColumn("_v", F.from_json("cleaned_json", VERDICT))
    bad = F.col("_v").isNull() | (F.coalesce("cleaned_json", F.lit("")) == "") | F.col("_v.is_vulnerable").isNull()
    error = F.coalesce("error", F.when(bad, "no verdict")) if "error" in replies.columns else F.when(bad, "no verdict")
    return rows.withColumn("error", error).select("*", "_v.*").drop("_v")
