"""Plans of queries that are to hold no more in a task, and to move no more, than their input asks for."""

from tidemark.plans import catalog, models, orders
from tidemark.session import dealt


def plan_of(spark, sf, name):
    """The plan, what comes last first, before it runs."""
    return catalog.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_dealt_by_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    assert [dealt(df, n, "k").rdd.getNumPartitions() for n in (0, 100_000, 100_001, 1_000_000)] == [1, 1, 2, 10]


def test_training_grid_is_not_shuffled(spark, sf):
    """Quotes are dealt out by number of rows, and the ninety rows of each stay where they are."""
    after_grid = plan_of(spark, sf, "m07_training_grid").split("Generate")[0]
    assert "Aggregate" in after_grid and "Exchange" not in after_grid


def test_candle_fills_stay_with_their_market(spark, sf, monkeypatch):
    """Orders and prints meet in the tasks that candles are dealt out to, as many as a larger table has."""
    monkeypatch.setattr(orders, "dealt", lambda df, _, *keys, **__: dealt(df, 1_000_000, *keys))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        above_union = plan_of(spark, sf, "m03_candle_fills").split("- Union")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Window" in above_union and "Exchange" not in above_union


def test_backfill_windows_are_dealt_out_once(spark, sf):
    """Markets and ranges are dealt out alike, so that neither the union, nor the join, nor the cut moves them again."""
    plan = plan_of(spark, sf, "s07_backfill_windows")
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan


def test_flow_rows_are_not_joined(spark, sf):
    """The rows of each side and limit meet no market."""
    assert "Join" not in plan_of(spark, sf, "c08_flow_observations").split("Generate")[0]


def test_queue_stays_with_its_market(spark, sf, monkeypatch):
    """The outcome of an order is found in the task of its market."""
    monkeypatch.setattr(models, "dealt", lambda df, _, *keys, **__: dealt(df, 1_000_000, *keys))
    plan = plan_of(spark, sf, "m05_queue_simulator").split("- Union")[0]
    assert "Window" not in plan and "Exchange" not in plan and "Join" not in plan


def test_old_snapshots_go_before_the_shuffle(spark, sf):
    """Q12: what is shuffled for the latest snapshot is what a part of the table has last."""
    assert "WindowGroupLimit" in plan_of(spark, sf, "q12_options_status")


def test_counts_of_markets_are_not_shuffled(spark, sf):
    """A market is counted in each cell where its quotes are dealt out to, before they are a row for each method; only its slices go by cell and market."""
    by_ticker = [x for x in plan_of(spark, sf, "j16_averaged_rates").splitlines() if "Exchange hashpartitioning(" in x and "ticker#" in x]
    assert by_ticker and all("bucket_index#" in x or "REPARTITION_BY_COL" in x for x in by_ticker)
