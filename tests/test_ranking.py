import random

from pyspark.sql import functions as F

from keyferry import schemas
from keyferry.functions.ranking import first_per_group, top_rows, with_position
from keyferry.operators import convergence as conv
from keyferry.operators.logs import LogFilter, search_logs


def test_large_top_k(spark):
    ids = random.Random(1).sample(range(1_000_000), 20_000)
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    for k in (5, 3000, 50_000):
        got = top_rows(rows, [F.desc("id")], k, F.floor(F.col("id") / 1000), bucket_desc=True)
        assert [r.id for r in got.collect()] == sorted(ids, reverse=True)[:k]
        got = top_rows(rows, [F.asc("id")], k, F.floor(F.col("id") / 1000))
        assert [r.id for r in got.collect()] == sorted(ids)[:k]


def test_hot_group_is_capped_exactly(spark):
    rows = spark.range(9000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("g"), "id")
    capped = first_per_group(rows, "g", ["id"], 4000, F.floor(F.col("id") / 128)).groupBy("g").agg(F.count("*").alias("n"), F.max("id").alias("m"))
    assert {r.g: (r.n, r.m) for r in capped.collect()} == {"hot": (4000, 5999), "cold": (3000, 8997)}


def test_positions_over_gaps(spark):
    numbers = sorted(random.Random(2).sample(range(10_000), 500))
    rows = spark.createDataFrame([("a", n) for n in numbers] + [("b", 77)], "g string, n long")
    placed = with_position(rows, "g", "n", 64).filter("g = 'a'").orderBy("n").collect()
    assert [r.position for r in placed] == list(range(1, 501))


def records(spark, counts, gap_s=60, total=1_000_000):
    rows = [("t", 3 * i, n, total, 1_704_067_200 + i * gap_s) for i, n in enumerate(counts)]
    table = spark.createDataFrame(rows, "task_id string, iteration int, change_count long, total_keys long, s long")
    return table.withColumn("ts", F.timestamp_seconds("s")).select(*schemas.CONVERGENCE.names)


def reasons(df):
    return [r.reason for r in df.orderBy("iteration").collect()]


def test_convergence_does_not_depend_on_chunks(spark):
    rng = random.Random(6)
    rows = records(spark, [rng.choice([900, 1500, 2500, 9000]) for _ in range(120)], gap_s=200)
    whole = reasons(conv.convergence(rows))
    assert reasons(conv.convergence(rows, chunk=7)) == whole == reasons(conv.convergence(rows, chunk=16))
    assert len(set(whole)) >= 3


def test_convergence_rules(spark):
    assert reasons(conv.convergence(records(spark, [999])))[0] == "change_count_below_threshold"
    assert reasons(conv.convergence(records(spark, [1000], total=1_000_001)))[0] == "change_rate_below_threshold"
    assert reasons(conv.convergence(records(spark, [1000], total=0)))[0] is None
    # the record exactly ten minutes old no longer counts
    stable = reasons(conv.convergence(records(spark, [3000, 2000, 2000], gap_s=300)))
    assert stable == [None, None, "window_changes_stable"]
    busy = reasons(conv.convergence(records(spark, [9000] * 11)))
    assert busy == [None] * 9 + ["max_iterations_reached"] * 2
    stop = conv.stopping_iteration(conv.convergence(records(spark, [9000] * 11))).first()
    assert (stop.iteration, stop.reason) == (27, "max_iterations_reached")


def test_log_pages(spark):
    rows = [(i, "2024-01-01 00:00:00.000", "INFO", f"m{i}", None, None, f"t{i % 2}", None, None) for i in range(3000)]
    logs = spark.createDataFrame(rows, schemas.LOG)
    ids = [i for i in range(2999, -1, -1) if i % 2]
    for offset, limit in ((0, 0), (10, 0), (1200, 0), (0, 7), (1490, 20), (1500, 5), (2000, 0)):
        got = search_logs(logs, LogFilter(task_id="t1"), offset, limit).collect()
        assert [r.id for r in got] == ids[offset : offset + limit if limit else None]
        assert all(r.total == 1500 for r in got)


def test_null_order_values_at_every_size(spark):
    rows = [(None if i % 10 == 0 else i, f"m{i}") for i in range(400)]
    table = spark.createDataFrame(rows, "id long, m string")
    bucket = F.floor(F.col("id") / 16)
    for k in (5, 50, 100, 101, 150, 370, 399, 400, 500):
        down = top_rows(table, [F.desc("id")], k, bucket, bucket_desc=True).collect()
        up = top_rows(table, [F.asc("id")], k, bucket).collect()
        assert len(down) == len(up) == min(k, 400)
        assert sum(r.id is None for r in down) == max(0, min(k, 400) - 360)
        assert sum(r.id is None for r in up) == min(k, 40)
        capped = first_per_group(table.withColumn("g", F.lit("a")), "g", ["id", "m"], k, bucket).collect()
        assert {r.m for r in capped} == {r.m for r in table.withColumn("g", F.lit("a")).orderBy("id", "m").limit(k).collect()}


def test_log_pages_with_rows_without_an_id(spark):
    rows = [(None if i % 7 == 0 else i, f"t{i:03}", "INFO", f"m{i}", None, None, "t", None, None) for i in range(350)]
    logs = spark.createDataFrame(rows, schemas.LOG)
    whole = [r.message for r in search_logs(logs).collect()]
    assert len(whole) == 350
    for offset in (1, 120, 299, 300, 310, 349, 350):
        assert [r.message for r in search_logs(logs, offset=offset).collect()] == whole[offset:]
        assert [r.message for r in search_logs(logs, offset=offset, limit=30).collect()] == whole[offset : offset + 30]


def test_log_pages_with_repeated_ids(spark):
    ids = [None if i % 9 == 0 else i // 40 if i > 100 else 90 + i // 60 for i in range(300)]
    rows = [(i, f"t{n % 5}", "INFO", f"m{n}", None, None, "t", None, None) for n, i in enumerate(ids)]
    logs = spark.createDataFrame(rows, schemas.LOG)
    whole = [r.message for r in search_logs(logs).collect()]
    assert len(whole) == 300
    for offset in (1, 2, 39, 40, 150, 266, 267, 280, 300):
        assert [r.message for r in search_logs(logs, offset=offset).collect()] == whole[offset:]
