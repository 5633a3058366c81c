"""Streams of check requests and of page figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from structaudit.operators.adjudicate import check_response, judge_service
from structaudit.operators.resolve import resolve


def answer_requests(requests: DataFrame, dict_df: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Judged requests: the claimed name is resolved, then the service rules apply.

    ``requests(request_id, name, reads)``.
    """
    found = resolve(requests.select(F.col("name").alias("query")), dict_df, cache)
    refs = found.select(
        F.col("query").alias("name"),
        F.col("matched_name").alias("ref_name"),
        F.col("inchikey").alias("ref_key"),
        F.col("formula").alias("ref_formula"),
        F.col("smiles").alias("ref_smiles"),
    )
    return judge_service(requests.join(refs, "name", "left"))


def check_stream(requests: DataFrame, dict_df: DataFrame, out_path: str, checkpoint: str) -> StreamingQuery:
    """Answer requests as they arrive; a request row carries its readings, so no state is kept.

    Every micro-batch overwrites its own folder, so a batch that is replayed after a failure does
    not answer twice.
    """

    def answer(batch: DataFrame, batch_id: int) -> None:
        check_response(answer_requests(batch, dict_df)).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    return (
        requests.writeStream.foreachBatch(answer)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedupe_stream(pictures: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """First copy of each figure per deck as pages arrive.

    A deck's copies are expected within ``delay`` of each other; later ones count as new.
    """
    return (
        pictures.withColumn("digest", F.sha2("content", 256))
        .drop("content")
        .withWatermark(ts_col, delay)
        .dropDuplicatesWithinWatermark(["deck", "digest"])
    )


def completed_requests(requests: DataFrame, readings: DataFrame, wait: str, delay: str) -> DataFrame:
    """Requests with all their readings, from two tables or two streams.

    ``requests(request_id, name, request_ts)`` and ``readings(request_id, read_no, engine, raw, inchikey,
    confidence, read_ts)``. A reading belongs to its request if it was made within ``wait`` after it, in
    whatever order the two arrive. On streams a request is given out once event time has passed ``wait`` and
    rows may come ``delay`` out of order; until then both sides are state, and afterwards they are forgotten.
    A request without readings comes with an empty array. As tables both give the same rows at once.
    """
    asked = requests.withWatermark("request_ts", delay)
    read = readings.withColumnRenamed("request_id", "of_request").withWatermark("read_ts", delay)
    within = F.expr(f"of_request = request_id and read_ts >= request_ts and read_ts <= request_ts + interval {wait}")
    one = F.when(F.col("of_request").isNotNull(), F.struct("read_no", "engine", "raw", "inchikey", "confidence"))
    # An item has one reading from each annotator's run, a handful; sorted by number, whatever arrived first.
    gathered = asked.join(read, within, "leftOuter").groupBy("request_id", "name", "request_ts").agg(F.sort_array(F.collect_list(one)).alias("numbered"))
    kept = F.transform("numbered", lambda r: F.struct(r["engine"], r["raw"], r["inchikey"], r["confidence"]))
    return gathered.select("request_id", "name", "request_ts", kept.cast("array<struct<engine:string,raw:string,inchikey:string,confidence:double>>").alias("reads"))


def late_check_stream(
    requests: DataFrame, readings: DataFrame, dict_df: DataFrame, out_path: str, checkpoint: str, wait: str = "10 minutes", delay: str = "1 minute"
) -> StreamingQuery:
    """:func:`check_stream` for requests whose readings arrive on a stream of their own."""
    return check_stream(completed_requests(requests, readings, wait, delay), dict_df, out_path, checkpoint)


def first_places(pictures: DataFrame, ts_col: str, delay: str) -> DataFrame:
    """Each figure of a deck with its earliest place, however its copies arrive.

    ``pictures(deck, page, pos, content)`` with an event time. Copies of a figure belong together as long as
    less than ``delay`` lies between one and the next; the figure is given out once that long has passed.
    What is kept of a figure is one row of (page, pos), not its copies.
    """
    seen = pictures.select("deck", F.sha2("content", 256).alias("digest"), "page", "pos", F.col(ts_col).alias("ts"))
    return (
        seen.withWatermark("ts", delay)
        .groupBy("deck", "digest", F.session_window("ts", delay).alias("session"))
        .agg(F.min(F.struct("page", "pos")).alias("first"), F.count("*").alias("n_copies"))
        .select("deck", "digest", F.col("first.page").alias("first_page"), F.col("first.pos").alias("first_pos"), "n_copies")
    )
