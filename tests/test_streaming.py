"""Hourly coverage as a stream against the same rows as a table."""

import datetime as dt

from pyspark.sql import functions as F

from zephyrgrid.streaming import hourly as H

START = dt.datetime(2024, 5, 1)


def rows(spark, minutes):
    return spark.createDataFrame([(f"t{i % 2}", START + dt.timedelta(minutes=m), None if m % 7 == 0 else float(m)) for i, m in enumerate(minutes)],
                                 "turbine string, ts timestamp, v double")


def table(df):
    return sorted(tuple(r) for r in df.select("turbine", "hour_end", "n_valid", "total").collect())


def test_micro_batches_add_up_to_the_table(spark, tmp_path):
    folder = str(tmp_path / "in")
    parts = [range(0, 200, 3), range(150, 400, 5), range(390, 900, 11)]
    for part in parts:
        rows(spark, part).coalesce(1).write.mode("append").parquet(folder)
    whole = spark.read.parquet(folder)
    made = H.follow(H.arriving(spark, folder, 1), ["turbine"], "ts", "v", delay="2 days")
    assert made.batches >= 3 and made.late == 0
    assert table(made.table(["turbine"])) == table(H.hourly_counts(whole, ["turbine"], "ts", "v"))


def test_late_rows_are_left_out_and_counted_and_a_later_call_goes_on(spark, tmp_path):
    folder, state, root = (str(tmp_path / n) for n in ("in", "state", "out"))
    rows(spark, [10, 20, 400]).coalesce(1).write.parquet(folder)
    follow = lambda: H.follow(H.arriving(spark, folder, 1), ["turbine"], "ts", "v", checkpoint=state, root=root)
    assert follow().late == 0
    # the watermark stands at minute 340: the first hour is closed, the one that ends at 360 is not
    rows(spark, [30, 350, 401]).coalesce(1).write.mode("append").parquet(folder)
    second = follow()
    assert second.late == 1
    kept = rows(spark, [10, 20, 400]).union(rows(spark, [30, 350, 401]).filter(F.minute("ts") != 30))
    assert table(second.table(["turbine"])) == table(H.hourly_counts(kept, ["turbine"], "ts", "v"))


def test_nothing_there_yet(spark, tmp_path):
    rows(spark, []).write.parquet(str(tmp_path / "in"))
    made = H.follow(H.arriving(spark, str(tmp_path / "in")), ["turbine"], "ts", "v")
    assert made.late == 0 and made.table(["turbine"]).count() == 0


def test_one_file_is_a_stream_too(spark, sf_dir):
    events = H.arriving(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "value")
    made = H.follow(events, [], "ts", "value")
    whole = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert made.table([]).agg(F.sum("n_valid")).first()[0] == whole.filter("value IS NOT NULL").count()
