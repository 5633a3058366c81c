"""Streams whose rows come out of order give what the same rows give as tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from structaudit.streaming.checks import answer_requests, completed_requests, first_places, late_check_stream

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
KEY, OTHER = "A" * 14 + "-" + "B" * 10 + "-N", "C" * 14 + "-" + "B" * 10 + "-N"
REQUESTS = "request_id bigint, name string, request_ts timestamp"
READINGS = "request_id bigint, read_no int, engine string, raw string, inchikey string, confidence double, read_ts timestamp"
PICTURES = "deck string, page int, pos int, ts timestamp, content binary"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def files(spark, tmp_path):
    """files(name, schema, batches): a stream that reads one batch after the other, and all of it as a table."""

    def make(name, schema, batches):
        path = tmp_path / name
        for i, rows in enumerate(batches):
            part = path / f"part={i:03d}"
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(part))
        paths = sorted(str(f) for f in path.glob("part=*/*.parquet"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(path / "*"))
        return stream, spark.read.schema(schema).parquet(*paths)

    return make


def drained(df, tmp_path, name):
    query = (df.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-ck"))
             .trigger(availableNow=True).start())
    query.awaitTermination(180)
    return df.sparkSession.read.parquet(str(tmp_path / name))


def batches():
    """Requests, and their readings of which some come before the request, some batches later, and some too late to count."""
    asked = [[(1, "Aspirin", at(0)), (2, "aspirin", at(5))], [(3, "nothing", at(20)), (4, "aspirin", at(30))], [(9, "flush", at(5000))], [(10, "flush", at(9000))]]
    read = [
        [(1, 1, "two", "CCO", KEY, None, at(8)), (4, 0, "one", "CCO", OTHER, 0.9, at(31))],
        [(1, 0, "one", "CCO", KEY, 0.9, at(2)), (3, 0, "one", "CCO", KEY, 0.9, at(22)), (1, 2, "three", "CC", OTHER, 0.1, at(900))],
        [(4, 1, "two", "CCO", KEY, 0.9, at(40)), (9, 0, "one", "C", KEY, 0.9, at(5001))], [(10, 0, "one", "C", KEY, 0.9, at(9000))],
    ]
    return asked, read


def test_late_readings_complete_a_request(spark, files, tmp_path):
    asked, read = batches()
    requests, all_requests = files("requests", REQUESTS, asked)
    readings, all_readings = files("readings", READINGS, read)
    plain = lambda df: {r["request_id"]: (r["name"], [tuple(x) for x in r["reads"]]) for r in df.collect()}
    want = plain(completed_requests(all_requests, all_readings, "5 minutes", "2 minutes"))
    assert want[1] == ("Aspirin", [("one", "CCO", KEY, 0.9), ("two", "CCO", KEY, None)]) and want[2] == ("aspirin", [])
    got = plain(drained(completed_requests(requests, readings, "5 minutes", "2 minutes"), tmp_path, "out"))
    # The last requests wait for event time to pass them.
    assert set(got) >= {1, 2, 3, 4} and all(got[i] == want[i] for i in got)


def test_late_checks_equal_batch(spark, files, tmp_path):
    asked, read = batches()
    requests, all_requests = files("requests", REQUESTS, asked)
    readings, all_readings = files("readings", READINGS, read)
    names = spark.createDataFrame([("aspirin", KEY, "C", "CCO")], "name_key string, inchikey string, formula string, smiles string")
    late_check_stream(requests, readings, names, str(tmp_path / "out"), str(tmp_path / "ck"), "5 minutes", "2 minutes").awaitTermination(180)
    verdicts = lambda df: {r["request_id"]: (r["verdict"], r["grade"]) for r in df.collect()}
    got = verdicts(spark.read.parquet(str(tmp_path / "out")))
    want = verdicts(answer_requests(completed_requests(all_requests, all_readings, "5 minutes", "2 minutes"), names))
    assert set(got) >= {1, 2, 3, 4} and all(got[i] == want[i] for i in got) and got[1] == ("match", "strong")


def test_first_place_does_not_depend_on_arrival(spark, files, tmp_path):
    rows = [("d", page, pos, at(page * 60 + pos), f"{(page * 3 + pos) % 4}".encode()) for page in range(1, 9) for pos in range(3)]
    rows += [("e", 2, 1, at(130), b"0"), ("e", 1, 2, at(131), b"0")]
    firsts = {}
    for deck, page, pos, _, content in rows:
        firsts[deck, content] = min((page, pos), firsts.get((deck, content), (99, 99)))
    for seed in (1, 2):
        shuffled = rows[:]
        random.Random(seed).shuffle(shuffled)
        parts = [shuffled[i : i + 7] for i in range(0, len(shuffled), 7)] + [[("z", 1, 1, at(90_000), b"z")], [("z", 1, 2, at(95_000), b"y")]]
        stream, table = files(f"pictures{seed}", PICTURES, parts)
        got = drained(first_places(stream, "ts", "1 hour"), tmp_path, f"places{seed}").where("deck <> 'z'")
        digests = {c: spark.sql(f"select sha2(cast('{c.decode()}' as binary), 256)").first()[0] for _, c in firsts}
        assert {(r["deck"], r["digest"]): (r["first_page"], r["first_pos"]) for r in got.collect()} == {(d, digests[c]): p for (d, c), p in firsts.items()}
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, first_places(table, "ts", "1 hour").where(F.col("deck") != "z").collect()))
