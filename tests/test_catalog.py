import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import duckdb
import pytest

from keystrata.operators import pubsub
from keystrata.plans import catalog

from oracle import connect, same

DATA = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    if name in ORACLES:
        same(df, duck, ORACLES[name])
    else:
        df.collect()


EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type varchar, value double, props varchar"


def events(folder, rows):
    """An events table of rows (ts, user, type, value) in `folder`, numbered as they come, and a connection to it."""
    c = duckdb.connect()
    c.execute(f"create table t({EVENTS})")
    c.executemany("insert into t values (?, ?, ?, ?, ?, '{}')", [(i, *r) for i, r in enumerate(rows)])
    c.execute(f"copy t to '{folder}/events.parquet' (format parquet)")
    return connect(folder)


def test_fold_takes_carts_that_cost_nothing(spark, tmp_path):
    """A purchase of 0 cents has a time to live of 0 ms: it replaces the cart, before and after END_MS."""
    days = ("2024-01-29 22:00:00", "2024-01-30 05:00:00")
    rows = [("2024-01-29 20:00:00", u, "purchase", v) for u, v in ((1, 500.0), (2, 500.0), (3, 0.0), (4, 500.0), (5, 0.0))]
    rows += [(days[0], 1, "purchase", 0.0), (days[1], 2, "purchase", 0.0), (days[1], 3, "purchase", 0.0), (days[1], 4, "purchase", 0.004), (days[1], 5, "purchase", 7.0), (days[1], 6, "purchase", 0.0)]
    c = events(tmp_path, rows)
    df = catalog.queries()["kv_fold_final"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [("{u2}:cart", "0"), ("{u3}:cart", "0"), ("{u4}:cart", "0"), ("{u5}:cart", "700"), ("{u6}:cart", "0")]
    same(df, c, ORACLES["kv_fold_final"])


def test_deliveries_of_odd_events(spark, tmp_path):
    """Subscriptions that stay open, are opened twice, last no message or the whole log; patterns
    and names; users without messages and messages without subscribers."""
    r = random.Random(8)
    kinds = ["signup"] * 2 + ["error"] + ["purchase"] * 3
    rows = [("2024-01-01", 7, "signup", 0.0), ("2024-01-01", 15, "signup", 0.0), ("2024-01-01", 9, "purchase", 1.0)]
    rows += [("2024-01-02", r.choice((1, 3, 11, 13, 15, 30, 45, 101)), r.choice(kinds), r.randrange(900) / 100) for _ in range(600)]
    rows += [("2024-01-03", 7, "purchase", 2.0), ("2024-01-03", 1, "signup", 0.0)]
    c = events(tmp_path, rows)
    for name in ("stream_pubsub", "ps_delivery", "ps_receivers"):
        df = catalog.queries()[name](spark, str(tmp_path))
        assert df.count() > 0
        same(df, c, ORACLES[name])


@pytest.mark.parametrize("left", ["signup", "purchase"])
def test_deliveries_of_one_side_only(spark, tmp_path, left):
    events(tmp_path, [("2024-01-01", u, left, 1.0) for u in range(1, 20)])
    for name in ("stream_pubsub", "ps_delivery"):
        assert catalog.queries()[name](spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("rounds", [1, 40, 4000])
def test_few_pairs_are_compared_that_are_no_deliveries(spark, rounds):
    """4000 subscriptions of one name, each open for so many rounds of a signup and a message:
    by name alone 16,000,000 pairs meet."""
    n = 4000
    subs = spark.range(n).selectExpr("id as conn", "'channel' as kind", "'c' as name", "2 * id as from_seq", f"if(id + {rounds} < {n}, 2 * id + 2 * {rounds}, null) as to_seq")
    msgs = spark.range(n).selectExpr("2 * id + 1 as seq", "'channel' as kind", "'c' as name", "'c' as channel", "'x' as payload")
    want = sum(min(rounds, n - i) for i in range(n))
    assert pubsub.fan_out(subs, msgs, ("kind", "name")).count() == want
    assert pubsub.candidates(subs, msgs, ("kind", "name")).count() <= 1.3 * want + n


def test_connections_meet_messages_by_bucket(spark):
    for name in ("stream_pubsub", "ps_delivery"):
        plan = catalog.queries()[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
        assert [x for x in plan.splitlines() if "Join Inner" in x and "from_seq" in x and "(bucket#" in x]
