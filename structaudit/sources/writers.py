"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from structaudit.functions.keys import json_confidence


def replay_items(reads: DataFrame, items: DataFrame) -> DataFrame:
    """Items beside their readings, for storing: one row per reading, with its number.

    An item without readings has one row and a null reading, so it is not lost.
    """
    reading = F.struct("read_no", "engine", "raw", "inchikey", json_confidence(F.col("confidence")).alias("confidence"))
    rows = reads.select("item_id", reading.alias("read"))
    return items.join(rows, "item_id", "left").withColumnRenamed("item_id", "index")


def write_replay(reads: DataFrame, items: DataFrame, path: str, engine_kind: str = "stored") -> None:
    """Store a line per reading with its item, and a one-row table of run metadata beside them."""
    replay_items(reads, items).write.mode("overwrite").json(f"{path}/items")
    engines = reads.select("engine").distinct().withColumn("engine_kind", F.lit(engine_kind))
    engines.write.mode("overwrite").json(f"{path}/engines")


def write_dictionary(df: DataFrame, path: str, source: str, generated: str) -> None:
    """Parquet rows, sorted within files by name, plus a one-row table of source, time and count."""
    df.repartitionByRange("name_key").sortWithinPartitions("name_key").write.mode("overwrite").parquet(f"{path}/entries")
    written = df.sparkSession.read.parquet(f"{path}/entries")
    meta = written.agg(F.count("*").alias("count")).select(
        F.lit(source).alias("source"), F.lit(generated).alias("generated"), "count"
    )
    meta.write.mode("overwrite").json(f"{path}/meta")


def write_dictionary_table(df: DataFrame, name: str, path: str, buckets: int) -> None:
    """The dictionary as table ``name``, bucketed and sorted by name: a lookup shuffles the names asked for, never the table."""
    (
        df.repartition(buckets, "name_key").write.mode("overwrite").option("path", path)
        .bucketBy(buckets, "name_key").sortBy("name_key").saveAsTable(name)
    )


def write_gated(outcomes: DataFrame, path: str, arms: Sequence[str], worst: str = "confident_wrong") -> dict[str, bool]:
    """Store outcomes (arm, outcome, ...) and say for each of ``arms`` whether nothing of the worst kind happened.

    The counts are observed while the rows are written, so the gate costs no pass of its own. An arm
    without rows has not passed.
    """
    seen = Observation("gate")
    is_arm = {arm: F.col("arm") == arm for arm in arms}
    counts = [F.count_if(test).alias(f"rows_{i}") for i, test in enumerate(is_arm.values())]
    bad = [F.count_if(test & (F.col("outcome") == worst)).alias(f"bad_{i}") for i, test in enumerate(is_arm.values())]
    outcomes.observe(seen, *counts, *bad).write.mode("overwrite").parquet(path)
    told = seen.get
    return {arm: told[f"rows_{i}"] > 0 and told[f"bad_{i}"] == 0 for i, arm in enumerate(arms)}


def write_scored(df: DataFrame, path: str) -> None:
    """One JSON line per scored image."""
    df.write.mode("overwrite").json(path)


def write_responses(df: DataFrame, path: str) -> None:
    """Responses as text, one JSON document per line."""
    df.select("response").write.mode("overwrite").text(path)
