import datetime
import random

import pytest

from scriptorium.streaming import stateful, streams

DAY = datetime.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp, event_type string, user_id long, value double"


def made(seed, days, n=300):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        ts = DAY + datetime.timedelta(days=rng.choice(days), seconds=rng.randint(0, 86399), microseconds=rng.randint(0, 999_999))
        rows.append((k, ts, rng.choice(["a", "b", None]), rng.randint(0, 5), rng.choice([None, rng.uniform(-20, 140)])))
    return rows


def expected(rows, reference, last):
    """Windows that end by the day `last`."""
    out = {}
    for _, ts, kind, _, v in rows:
        if v is not None and (ts - DAY).days < last:
            out.setdefault((kind, (ts - DAY).days), [0] * 10)[min(max(int(v // 10), 0), 9)] += 1
    return sorted(((k, d, sum(c), round(stateful.index(reference, c), 9)) for (k, d), c in out.items()), key=repr)


def rows_of(df):
    return sorted(((r.event_type, (r.start - DAY).days, r.n, r.psi) for r in df.collect()), key=repr)


REFERENCE = [5, 10, 10, 10, 20, 10, 10, 10, 10, 5]


def test_batch_and_stream_agree_after_a_restart(spark, tmp_path):
    """Three files; the stream is stopped after each and started anew. Late rows within the watermark count, closed windows stay closed."""
    src, place = f"{tmp_path}/in", f"{tmp_path}/out"
    files = [made(1, [0, 1]), made(2, [1, 2]), [(1, DAY + datetime.timedelta(days=9), "a", 1, 5.0)]]
    late = [(999, DAY + datetime.timedelta(hours=3), "a", 1, 50.0)]  # its day is closed by the third file
    for k, rows in enumerate([*files, [*late, (2, DAY + datetime.timedelta(days=12), "b", 1, 5.0)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = streams.run_available(stateful.drift(spark.readStream.schema(SCHEMA).parquet(src), REFERENCE), "drift", checkpoint=place)
        seen = rows_of(got)
        assert len(seen) == len(set(seen))
    every = [r for f in files for r in f]
    assert seen == expected(every, REFERENCE, 10)
    batch = stateful.drift(spark.createDataFrame(every, SCHEMA), REFERENCE)
    assert rows_of(batch) == expected(every, REFERENCE, 99)


def test_rates_on_a_stream(spark, tmp_path):
    src, place = f"{tmp_path}/in", f"{tmp_path}/out"
    rows = made(3, [0, 1], 600)
    for part in (rows[:300], rows[300:], [(1, DAY + datetime.timedelta(days=5), "a", 1, 1.0)]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        got = streams.run_available(stateful.rates(spark.readStream.schema(SCHEMA).parquet(src), 3, delay="2 days"), "rates", checkpoint=place)
    count = {}
    for _, ts, _, u, _ in rows:
        k = (u, ts.replace(minute=0, second=0, microsecond=0))
        count[k] = count.get(k, 0) + 1
    assert sorted((r.user_id, r.start, r.n) for r in got.collect()) == sorted((*k, n) for k, n in count.items() if n > 3)


def test_histogram_and_index(spark):
    df = spark.createDataFrame([(x,) for x in (-5.0, 0.0, 9.99, 10.0, 99.0, 100.0, 500.0, None)], "value double")
    assert stateful.histogram(df, "value", 0.0, 100.0, 10) == [3, 1, 0, 0, 0, 0, 0, 0, 0, 3]
    assert stateful.index([1, 1], [5, 5]) == 0 and stateful.index([1, 0], [0, 1]) == pytest.approx(2 * (1 - 1e-6) * 13.815510557964274)
