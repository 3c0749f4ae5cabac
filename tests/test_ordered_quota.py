"""The streamed quota in order of time, across batches that come in another one, restarts and late calls."""

import datetime as dt
import random

import pytest

from lumendoc.streaming import ordered_quota

DAY = dt.datetime(2024, 3, 1)


@pytest.fixture()
def session(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    ordered_quota.use_rocksdb(spark)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_order_across_batches_and_restarts(session, tmp_path):
    rnd = random.Random(2)
    calls = [(k, f"u{k % 2}", DAY + dt.timedelta(minutes=7 * k)) for k in range(60)]
    # minutes of neighbours are swapped between batches, never by more than the watermark allows
    batches = [calls[0:20:2] + calls[20:24], calls[1:20:2], calls[24:60:3] + calls[25:60:3], calls[26:60:3]]
    batches += [[(1000, "u0", DAY + dt.timedelta(days=2))], [(1001, "u0", DAY + dt.timedelta(minutes=1)), (1002, "u1", DAY + dt.timedelta(days=2, hours=6))]]
    schema = "event_id long, user string, ts timestamp"
    source, out, checkpoint = (f"{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    for batch in batches:  # each batch is a run of its own: the query starts anew from its checkpoint
        rnd.shuffle(batch)
        session.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(source)
        events = session.readStream.schema(schema).parquet(source)
        told = ordered_quota.stream_quota(events, "user", limit=5, late="6 hours")
        told.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", out).trigger(availableNow=True).start().awaitTermination()
    got = {r["tie"]: r["allowed"] for r in session.read.parquet(out).collect()}
    assert set(got) == {*range(60), 1000} and got[1000]  # 1001 came too late and has no turn, 1002 waits
    for user in (0, 1):
        mine = [k for k in range(60) if k % 2 == user]
        assert [got[k] for k in mine] == [n < 5 for n in range(30)]
