"""Series queries against their SQL on events that the generated tables lack."""

import datetime as dt
import math

import duckdb
import pandas as pd
from compare import assert_same

import __spark_entry__ as entry
from gridstat.operators import sequence as Q

DAY = dt.datetime(2024, 1, 1)


def both(spark, folder, rows, name):
    """A query's result and its SQL's, over events (user_id, minute, event_type, value) in the order given."""
    events = pd.DataFrame([(i, DAY + dt.timedelta(minutes=m), u, e, v, "{}") for i, (u, m, e, v) in enumerate(rows)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    con = duckdb.connect(config={"threads": 1})
    con.register("events", events)
    con.execute(f"COPY (SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM events) TO '{folder}/events.parquet'")
    con.unregister("events")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    return entry.queries()[name](spark, str(folder)), con.execute(entry.oracle_sql()[name]).df()


ONE = [(u, m, e, float(3 + (7 * u + 5 * m) % 11)) for u in range(4) for e in ("click", "view") for m in range(6)] + [(1, 9, "error", 2.5)]


def test_summary_with_a_sequence_of_one_event(spark, tmp_path):
    got, want = both(spark, tmp_path, ONE, "growth_summary")
    assert_same(got.toPandas(), want)
    assert got.where("feature = 'growth_rate' and isnan(mean) and isnan(std) and isnan(cv)").count() == 1


def test_trends_of_a_sequence_of_one_event(spark, tmp_path):
    got, want = both(spark, tmp_path, ONE, "series_trends")
    assert_same(got.toPandas(), want)
    one = got.where("n = 1").first()
    assert math.isnan(one["growth_rate"]) and one["trend_strength"] == 0 and one["detrended_variance"] is None


def test_value_at_the_mean_whatever_the_order_of_rows(spark, tmp_path):
    """0.3 is the mean; added up in the sequence's order it comes out above 0.3, backwards it doesn't."""
    ys = [0.1, 0.4, 0.3, 0.4, 0.3]
    got, want = both(spark, tmp_path, [(u, m, "click", y) for u in range(20) for m, y in reversed(list(enumerate(ys)))], "series_events")
    assert_same(got.toPandas(), want)
    assert {r["crossings"] for r in got.collect()} == {4}


def test_events_without_a_user(spark, tmp_path):
    """Rows without a user are of no sequence; the SQL's join leaves them out."""
    s = spark.createDataFrame([(k, t, float(t % 3)) for k in (1, None) for t in range(9)], "sample_id long, t long, y double")
    assert [r["sample_id"] for r in Q.events(s, ["sample_id"]).collect()] == [1]
