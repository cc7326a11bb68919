"""Keyed state, restarts, recomputation in the stream and published versions."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strandline.plans import published
from strandline.streaming import keyed, live, model


def at(day, hour=10):
    return dt.datetime(2026, 1, day, hour)


EARLY = [(i, at(1, i % 7), i % 3, "view" if i % 5 else "error", float(i - 2), "") for i in range(30)]
LATER = [(100, at(2), 1, "view", 77.0, ""), (101, dt.datetime(2025, 1, 1), 2, "view", 5.0, ""), (102, at(2), 0, "view", float("inf"), ""), (103, at(3), None, "view", 9.0, ""), (104, None, 2, "view", 9.0, "")]


def send(spark, rows, path):
    spark.createDataFrame(rows, live.QUOTE).coalesce(1).write.mode("append").parquet(path)


def test_only_changed_symbols_leave_a_batch_and_the_state_survives_a_restart(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("in", "cp", "out")}
    for rows in (EARLY, LATER):
        send(spark, rows, paths["in"])
        keyed.start_changes(spark, paths["in"], paths["cp"], paths["out"]).awaitTermination()
    got = spark.read.parquet(paths["out"])
    first = {r.symbol: r.price for r in got.filter("batch = 0").collect()}
    assert first == {r.symbol: r.price for r in live.latest(live.quotes(spark.createDataFrame(EARLY, live.QUOTE))).collect()}
    assert [(r.symbol, r.old_price, r.price) for r in got.filter("batch = 1").collect()] == [(1, first[1], 77.0)]
    state = spark.read.format("statestore").option("stateVarName", "last").load(paths["cp"]).select("key.symbol", "value.price")
    every = live.latest(live.quotes(spark.createDataFrame(EARLY + LATER, live.QUOTE))).filter("symbol IS NOT NULL")
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, every.select("symbol", "price").collect()))


def test_a_batch_that_repeats_a_price_or_comes_late_emits_nothing(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("in", "cp", "out")}
    batches = [[(1, at(5), 1, "view", 10.0, "")], [(2, at(6), 1, "view", 10.0, "")], [(3, at(4), 1, "view", 99.0, "")], [(4, at(6), 1, "view", 11.0, "")], [(4, at(6), 1, "view", 12.0, "")]]
    for rows in batches:
        send(spark, rows, paths["in"])
        keyed.start_changes(spark, paths["in"], paths["cp"], paths["out"]).awaitTermination()
    got = [(r.symbol, r.old_price, r.price, r.batch) for r in spark.read.parquet(paths["out"]).collect()]
    # the second is later with the same price, the third is older, the fourth ties in time and has the larger event, the fifth is no later event
    assert sorted(got, key=lambda r: r[3]) == [(1, None, 10.0, 0), (1, 10.0, 11.0, 3)]


def test_quotes_outside_the_session_and_dead_letters(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("in", "cp", "out", "cp2", "dead")}
    send(spark, [(1, at(5, 10), 1, "view", 10.0, ""), (2, at(5, 20), 1, "view", 50.0, ""), (3, at(3, 10), 2, "view", 7.0, ""), (4, at(5, 10), 3, "error", 7.0, ""), (5, at(5, 10), 3, "view", -7.0, "")], paths["in"])
    from strandline.functions.scalar import market_open

    keyed.start_changes(spark, paths["in"], paths["cp"], paths["out"], gate=market_open(F.col("ts"))).awaitTermination()
    assert [(r.symbol, r.price) for r in spark.read.parquet(paths["out"]).collect()] == [(1, 10.0)]  # 3 January 2026 is a Saturday
    for _ in range(2):
        keyed.start_dead_letters(spark, paths["in"], paths["cp2"], paths["dead"]).awaitTermination()
    assert sorted((r.event_id, r.reject_reason) for r in spark.read.parquet(paths["dead"]).collect()) == [(4, "status"), (5, "no price")]


def _rank_model(rows):
    from pyspark.sql import Window

    return rows.withColumn("verdict", F.when(F.row_number().over(Window.orderBy(F.desc("ff"), "k")) == 1, "first").otherwise("other"))


def test_model_in_the_stream_emits_moved_prices_and_flipped_verdicts_once(spark, tmp_path):
    base = spark.createDataFrame([(k, 100.0 + k, 10.0, 1.0, 10.0 * (100 + k)) for k in range(5)], "k long, price double, shares double, factor double, ff double")
    paths = {k: str(tmp_path / k) for k in ("in", "cp", "out")}
    for rows in ([(1, at(5), 2, "view", 500.0, ""), (2, at(5), 77, "view", 5.0, "")], [(3, at(6), 3, "view", 90.0, "")], [(4, at(7), 2, "view", 1.0, "")]):
        send(spark, rows, paths["in"])
        model.start_model(spark, base, paths["in"], paths["cp"], paths["out"], _rank_model, "k").awaitTermination()
    got = sorted(((r.batch, r.k, r.price_changed, r.before, r.after) for r in spark.read.parquet(f"{paths['out']}/changes").collect()))
    assert got == [(0, 2, True, "other", "first"), (0, 4, False, "first", "other"), (1, 3, True, "other", "other"), (2, 2, True, "first", "other"), (2, 4, False, "other", "first")]
    now = published.current(spark, f"{paths['out']}/snapshot")
    assert now.version == 3
    # a batch that runs again after its commit changes nothing
    moved = spark.createDataFrame([(4, 9999.0)], "symbol long, price double")
    assert not model.apply_batch(spark, base, moved, _rank_model, "k", paths["out"], 2)
    assert published.current(spark, f"{paths['out']}/snapshot") == now and spark.read.parquet(f"{paths['out']}/changes").count() == 5


def test_overlay_takes_over_the_previous_close_the_day_change_and_the_staleness(spark):
    base = spark.createDataFrame([(1, 100.0, 90.0, 3, 2.0, 0.5, 100.0), (2, 100.0, 80.0, 2, 2.0, 0.5, 100.0), (3, None, 80.0, None, 2.0, 0.5, None)], "k long, price double, prev_close double, stale_days int, shares double, factor double, ff double")
    now = spark.createDataFrame([(1, 120.0, 96.0)], "symbol long, price double, prev_close double")
    got = {r.k: (r.price, r.prev_close, r.stale_days, r.tier, r.exchange, r.ff, r.eod_price, r.day_change_pct) for r in live.overlaid(base, now, "k").collect()}
    assert got == {1: (120.0, 96.0, 0, "live", "NSE", 120, 100.0, 25.0), 2: (100.0, 80.0, 2, "stale", "BSE", 100, 100.0, 25.0), 3: (None, None, None, None, None, None, None, None)}
    plain = live.overlaid(base.drop("prev_close", "stale_days"), now.drop("prev_close"), "k").filter("k = 1").first()
    assert (plain.price, plain.prev_close, plain.day_change_pct, plain.stale_days) == (120.0, None, None, 0)


def test_published_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    assert published.current(spark, path) is None
    with pytest.raises(FileNotFoundError):
        published.published(spark, path)
    for v in range(3):
        df = spark.range(v + 1)
        data = published.stage(df, path)
        seen = published.current(spark, path)
        assert (seen.version if seen else None) == (v - 1 if v else None)  # staged rows are seen by nobody
        published.publish(spark, path, data, df.schema, v, {"by": v})
        assert published.published(spark, path).count() == v + 1 and published.current(spark, path).notes == {"by": v}
    with pytest.raises(published.Conflict):
        published.publish(spark, path, published.stage(spark.range(9), path), spark.range(9).schema, 2)
    assert published.published(spark, path).count() == 3
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("data-")]) == 3  # two versions and the refused one


def test_a_failing_stream_is_started_again_after_growing_waits(spark, tmp_path):
    paths = {k: str(tmp_path / k) for k in ("in", "cp", "out")}
    send(spark, EARLY[:6], paths["in"])
    waits, left = [], [4]

    def start():
        def each(batch, n):
            left[0] -= 1
            if left[0] > 0:
                raise ValueError("the store is away")
            batch.write.mode("overwrite").parquet(f"{paths['out']}/batch={n}")

        return keyed.events_in(spark, paths["in"]).writeStream.foreachBatch(each).option("checkpointLocation", paths["cp"]).trigger(availableNow=True).start()

    keyed.run_with_backoff(start, 5, 1.0, 3.0, waits.append)
    assert waits == [1.0, 2.0, 3.0] and spark.read.parquet(paths["out"]).count() == 6
    left[0] = 99
    send(spark, EARLY[6:8], paths["in"])
    with pytest.raises(Exception, match="the store is away"):
        keyed.run_with_backoff(start, 2, 1.0, 3.0, waits.append)
    assert waits[3:] == [1.0]
