"""Sessions in event time: turns out of order, silence, late turns, state that ends."""

import datetime as dt
import random

import pytest

from wayfind.streaming.sessions import session_for, sessions

START = dt.datetime(2024, 1, 1)
SCHEMA = "conv_id long, turn long, role string, text string, ts timestamp"


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def run(spark, folder, batches, **more):
    own = session_for(spark)
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in/{k}")
    stream = own.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    q = sessions(stream, **more).writeStream.format("parquet").option("checkpointLocation", f"{folder}/c").option("path", f"{folder}/out").trigger(availableNow=True).start()
    q.awaitTermination(200)
    out = spark.read.parquet(f"{folder}/out").filter("conv_id is not null").collect()
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp() * 10**6)
    return sorted((r.conv_id, (r.began - base) // 60_000_000, r.turn, r.notice, r.gone) for r in out)


def expected(rows, gap):
    out = []
    for conv in {r[0] for r in rows}:
        said = left = False
        last = began = None
        for _, turn, role, text, ts in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[4], r[1])):
            if last is None or ts - last > dt.timedelta(minutes=gap):
                said, left, began = False, False, ts
            left = left or (role == "user" and (text or "").strip().lower() in ("quit", "exit", "bye"))
            hit = role == "assistant" and any(w in (text or "").lower() for w in ("diagnosis", "it appears", "likely cause")) and not left
            out.append((conv, (began - START) // dt.timedelta(minutes=1), turn, hit and not said, left))
            said, last = said or hit, ts
    return sorted(out)


@pytest.mark.parametrize("cuts", [1, 5])
def test_any_order_within_the_delay(spark, tmp_path, cuts):
    r = random.Random(cuts)
    say = lambda: r.choice(["hm", None, "It appears so", "the DIAGNOSIS", " quit\n", "likely cause"])
    rows = [(c, t, r.choice(["user", "assistant"]), say(), at(r.choice([0, 70, 200]) + 3 * t + c)) for c in range(6) for t in range(8)]
    r.shuffle(rows)
    batches = [rows[k::cuts] for k in range(cuts)] + [[(None, 0, "end", "", at(10**5))]]
    assert run(spark, tmp_path, batches, delay="10 days", gap_minutes=50) == expected(rows, 50)


def test_late_turns_go_and_silent_sessions_end(spark, tmp_path):
    first = [(1, 0, "assistant", "diagnosis", at(0)), (1, 1, "assistant", "diagnosis", at(5))]
    tick = lambda m: (None, 0, "end", "", at(m))
    batches = [first, [tick(100)], [tick(101), (1, 2, "assistant", "too late", at(20))], [(1, 3, "assistant", "it appears", at(130)), tick(300)], [tick(301)], [tick(10**5)]]
    got = run(spark, tmp_path, batches, delay="10 minutes", gap_minutes=60)
    assert got == [(1, 0, 0, True, False), (1, 0, 1, False, False), (1, 130, 3, True, False)]


def test_a_null_key_takes_no_other_conversation_along(spark, tmp_path):
    """One partition, and so one Arrow batch, has the null key and all others."""
    rows = [(c, t, "assistant", "diagnosis", at(3 * t)) for c in range(5) for t in range(3)] + [(None, 0, "user", "bye", at(0))]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 1)
    try:
        run(spark, tmp_path, [rows + [(None, 9, "end", "", at(10**5))]], delay="10 minutes")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = {(r.conv_id, r.turn, r.notice, r.gone) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(c, t, t == 0, False) for c in range(5) for t in range(3)} | {(None, 0, False, True)}  # the last tick stays


def test_streams_read_folders_and_long_conversations(spark, tmp_path):
    """Tables that are folders of many files, and turns far beyond the delay: the streams give what their batch forms give."""
    from pyspark.sql import functions as F

    from wayfind import catalogue as C

    rows = [(c, t, "user" if t % 2 else "assistant", "hm") for c in range(8) for t in range(90)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(16).write.parquet(f"{tmp_path}/conversations.parquet")
    got = C.stream_notices(spark, str(tmp_path)).collect()
    want = C.diagnosis_latch(spark, str(tmp_path)).select("conv_id", "turn", "notice").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == len(rows)
    out = C.stream_sessions(spark, str(tmp_path))
    assert sorted((r.conv_id, r.turn) for r in out.collect()) == [(c, t) for c, t, *_ in sorted(rows)]
    assert out.filter("turn < 3").agg(F.max("began")).first()[0] < 10 and out.filter("turn >= 3").agg(F.min("began")).first()[0] >= 106
