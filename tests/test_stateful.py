import time

import pytest

from statloom.operators import stateful
from statloom.streaming.limits import rate_limit_stream

EVENTS = "user long, at long, id long, failed boolean, state string"


def events(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], EVENTS)


def test_rate_limit_windows_start_at_the_first_request(spark):
    rows = [(1, 0, 1, False), (1, 10, 2, False), (1, 20, 3, False), (1, 1000, 4, False), (2, 20, 5, False), (None, 5, 6, False), (1, 0, 0, False)]
    got = {r.id: (r.allowed, r.remaining) for r in stateful.rate_limit(events(spark, rows), "user", "at", "id", 2, 1000).collect()}
    assert got == {0: (True, 1), 1: (True, 0), 2: (False, 0), 3: (False, 0), 4: (True, 1), 5: (True, 1), 6: (True, 1)}
    assert stateful.rate_limit(events(spark, []), "user", "at", "id", 2, 1000).count() == 0


def test_circuit_breaker(spark):
    fail = [True, True, False, True, True, False, False, True, True]
    at = [0, 1, 2, 3, 4, 5, 200, 201, 202]
    rows = [(1, t, i, f) for i, (t, f) in enumerate(zip(at, fail, strict=True))]
    got = [(r.admitted, r.state) for r in stateful.circuit_breaker(events(spark, rows), "user", "at", "id", "failed", 2, 100).orderBy("id").collect()]
    assert got == [(True, "closed"), (True, "open"), (False, "open"), (False, "open"), (False, "open"), (False, "open"), (True, "closed"), (True, "closed"), (True, "open")]
    half = [(1, 0, 0, True), (1, 1, 1, True), (1, 150, 2, True), (1, 200, 3, False)]
    got = [(r.admitted, r.state) for r in stateful.circuit_breaker(events(spark, half), "user", "at", "id", "failed", 2, 100).orderBy("id").collect()]
    assert got[2:] == [(True, "open"), (False, "open")]


def test_admission(spark):
    requests = spark.createDataFrame([(1, "ok"), (2, "ok"), (3, " "), (4, "too long a text"), (5, None)], "id long, t string")
    decisions = spark.createDataFrame([(1, True), (2, False), (3, False), (4, True)], "id long, allowed boolean")
    got = {r.id: r.status for r in stateful.admission(requests, decisions, "id", "t", 10).collect()}
    assert got == {1: 200, 2: 429, 3: 429, 4: 400, 5: 400}


def test_one_key_may_hold_most_rows(spark):
    rows = [(7 if i % 3 else i, i, i, False) for i in range(30_000)]
    got = stateful.rate_limit(events(spark, rows), "user", "at", "id", 10, 1_000)
    assert got.filter("user = 7 and allowed").count() == 10 * 30 and got.count() == 30_000


def test_health_and_input(spark):
    checks = spark.createDataFrame([("a", "healthy"), ("a", "degraded"), ("b", "healthy"), ("c", "odd"), ("c", None)], "name string, s string")
    assert {tuple(r) for r in stateful.health(checks, "name", "s").collect()} == {("a", "degraded", 2), ("b", "healthy", 1), ("c", "unhealthy", 2)}
    texts = spark.createDataFrame([("ok",), (" 　",), (None,), ("x" * 11,), ("a\0b",)], "t string")
    assert [r[0] for r in texts.select(stateful.input_status(texts.t, 10)).collect()] == ["ok", "empty", "empty", "too-long", "invalid"]


def test_streaming_rate_limit(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    schema = "user long, at long"
    for i, rows in enumerate(([(1, 0), (1, 10), (2, 5)], [(1, 20), (1, 1_000), (2, 6)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = rate_limit_stream(spark.readStream.schema(schema).parquet(str(source)), "user", "at", 2, 1_000)
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(out)).outputMode("append").trigger(availableNow=True).start()
        started = time.time()
        while query.isActive and time.time() - started < 100:
            query.awaitTermination(5)
        assert query.exception() is None
    got = {(r.user, r.at): (r.allowed, r.remaining) for r in spark.read.parquet(str(out)).collect()}
    assert got == {(1, 0): (True, 1), (1, 10): (True, 0), (2, 5): (True, 1), (1, 20): (False, 0), (1, 1_000): (True, 1), (2, 6): (True, 0)}


def test_keys_keep_their_type(spark):
    rows = spark.createDataFrame([("a b", 0, 1, False), (None, 1, 2, True)], "`the key` string, at long, id int, failed boolean")
    limited, broken = stateful.rate_limit(rows, "the key", "at", "id"), stateful.circuit_breaker(rows, "the key", "at", "id", "failed")
    for df in (limited, broken):
        assert [df.schema[c].dataType.simpleString() for c in ("the key", "at", "id")] == ["string", "bigint", "int"]
        assert {r["the key"] for r in df.collect()} == {"a b", None}
