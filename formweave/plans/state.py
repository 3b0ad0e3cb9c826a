"""State machines, counters and streams."""

import uuid

from pyspark.sql import functions as F

from formweave.plans.fixtures import Rows, table
from formweave.plans.registry import query
from formweave.sources.shared import new_folder
from formweave.sources.store import Store, sync_available
from formweave.streaming import events as S
from formweave.streaming import machines as M
from formweave.streaming import timers as T

_PARTIES = Rows("parties", "txn_id string,party string", [("t1", "a"), ("t1", "b"), ("t2", "a"), ("t3", "a"), ("t3", "b"), ("t4", "a")]).over(txn_id="txn_id || '-' || c_custkey")
_EVENTS = Rows(
    "ev", "txn_id string,seq bigint,action string,party string",
    [("t1", 1, "start", None), ("t1", 2, "consent", "a"), ("t1", 3, "assemble", None), ("t1", 4, "consent", "b"), ("t1", 5, "assemble", None), ("t1", 6, "circulate", None), ("t1", 7, "sign", "a"),
     ("t2", 1, "start", None), ("t2", 2, "consent", "a"), ("t2", 3, "assemble", None), ("t2", 4, "circulate", None), ("t2", 5, "sign", "a"), ("t2", 6, "withdraw", None),
     ("t3", 1, "start", None), ("t3", 2, "consent", "a"), ("t3", 3, "consent", "b"), ("t3", 4, "assemble", None), ("t3", 5, "circulate", None), ("t3", 6, "sign", "a"), ("t3", 7, "request_changes", None), ("t4", 1, "withdraw", None), ("t4", 2, "start", None)],
).over(txn_id="txn_id || '-' || c_custkey")
_STATES_SQL = "SELECT txn_id || '-' || c_custkey AS txn_id, state, n_signed, n_errors FROM customer CROSS JOIN (VALUES ('t1', 'PartiallySigned', 1::BIGINT, 1::BIGINT), ('t2', 'FullyExecuted', 1, 1), ('t3', 'ChangesRequested', 0, 0), ('t4', 'Withdrawn', 0, 1)) v(txn_id, state, n_signed, n_errors)"


@query("st1_transactions", _STATES_SQL)
def st1(spark, sf):
    return M.fold_transactions(_EVENTS.frame(spark, sf), _PARTIES.frame(spark, sf))


_HOOKS = Rows("hooks", "seq bigint,event_id string,event_name string", [(1, "e1", "order_created"), (2, "e1", "order_created"), (3, "e2", "ping"), (4, "e2", "order_refunded"), (5, "", "order_created"), (6, "", "order_created"), (7, "e2", "order_refunded"), (8, None, "order_created")]).over(seq="c_custkey * 100 + seq", event_id="CASE WHEN event_id = '' THEN '' ELSE event_id || '-' || c_custkey END")


@query("st2_consume_once", f"WITH {_HOOKS.cte}, k AS (SELECT *, CASE WHEN event_name IN ('order_created', 'subscription_created') THEN 'issue' WHEN event_name IN ('order_refunded', 'subscription_expired') THEN 'revoke' ELSE 'ignore' END AS kind FROM hooks) SELECT seq, event_id, CASE WHEN kind <> 'ignore' AND coalesce(event_id, '') <> '' AND EXISTS (SELECT 1 FROM k o WHERE o.event_id = k.event_id AND o.seq < k.seq AND o.kind <> 'ignore') THEN 'duplicate' ELSE kind END AS outcome FROM k")
def st2(spark, sf):
    return M.consume_once(_HOOKS.frame(spark, sf))


@query("st3_heartbeat", "WITH l AS (SELECT user_id, max(date_diff('second', TIMESTAMP '1970-01-01', ts)) AS t FROM events GROUP BY 1), n AS (SELECT max(t) AS now FROM l) SELECT user_id, now - t <= 3600 AS fresh FROM l CROSS JOIN n")
def st3(spark, sf):
    from formweave.functions.predicates import fresh

    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    last = table(spark, sf, "events").groupBy("user_id").agg(F.max(seconds).alias("t"))
    return last.crossJoin(F.broadcast(last.agg(F.max("t").alias("now")))).select("user_id", fresh(F.col("t"), F.col("now"), F.lit(3600)).alias("fresh"))


_STEPS = Rows(
    "steps", "run_id string,step bigint,filled bigint,saved bigint,auth boolean,n_required_empty bigint,submit boolean,advance boolean,moved boolean",
    [("a", 1, 3, 1, False, 0, False, True, True), ("a", 2, 2, 0, False, 1, True, False, True), ("a", 3, 9, 9, False, 0, False, True, True), ("b", 1, 1, 1, True, 2, True, True, True), ("c", 1, 1, 0, False, 0, False, True, True), ("c", 2, 1, 0, False, 0, True, False, True),
     ("d", 1, 4, 0, False, 0, False, False, True), ("e", 1, 4, 0, False, 0, False, True, False), ("f", 1, 5, 5, False, 0, False, True, True)],
).over(run_id="run_id || '-' || c_custkey", filled="filled + c_nationkey")


@query("st4_step_loop", "SELECT run_id || '-' || c_custkey AS run_id, stop, step, filled + step * c_nationkey AS filled, saved FROM customer CROSS JOIN (VALUES ('a', 'needs-you', 2::BIGINT, 5::BIGINT, 1::BIGINT), ('b', 'sign-in', 1, 1, 1), ('c', 'at-submit', 2, 2, 0), ('d', 'no-next', 1, 4, 0), ('e', 'stuck', 1, 4, 0), ('f', 'max-steps', 1, 5, 5)) v(run_id, stop, step, filled, saved)")
def st4(spark, sf):
    return M.stop_reasons(_STEPS.frame(spark, sf))


@query("st5_stream_counters", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st5(spark, sf):
    stream = S.event_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    return S.drain(S.counts(stream), f"counters_{uuid.uuid4().hex}", "complete")


@query("st5_windowed_stream", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def st5_windows(spark, sf):
    stream = S.event_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    out = S.drain(S.windowed(stream), f"windows_{uuid.uuid4().hex}", "update")
    return out.groupBy(F.to_date(F.col("w.start")).alias("day"), "event_type").agg(F.max("n").alias("n"))


_TXN = Rows("txn", "txn_id string,party string,consented boolean,signed boolean", [("t1", "a", True, True), ("t1", "b", True, False), ("t2", "a", True, True), ("t3", "a", False, False)]).over(txn_id="txn_id || '-' || c_custkey", signed="CASE WHEN c_custkey % 2 = 1 THEN NOT signed ELSE signed END")


@query("a4_all_parties", f"WITH {_TXN.cte} SELECT txn_id, bool_and(consented) AS all_consented, bool_and(signed) AS all_signed FROM txn GROUP BY 1")
def a4(spark, sf):
    return _TXN.frame(spark, sf).groupBy("txn_id").agg(F.bool_and("consented").alias("all_consented"), F.bool_and("signed").alias("all_signed"))


@query("a21_counter", "SELECT event_type, count(*) + 100 AS n FROM events GROUP BY 1")
def a21(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg((F.count(F.lit(1)) + 100).alias("n"))


@query("st6_convergent_sync", "SELECT count(DISTINCT (user_id, event_type)) AS n, 0::BIGINT AS differing FROM events")
def st6(spark, sf):
    """After both directions of a sync are applied the two vaults agree and have lost no key."""
    from formweave.operators.reconcile import reconcile
    from formweave.operators.store import upsert
    from formweave.plans.reconcile import side

    keys, a, b = ["user_id", "key"], side(spark, sf, 0), side(spark, sf, 1)
    plan = reconcile(a, b, keys)
    x = upsert(a, plan.where("direction = 'to_local'").drop("direction"), keys, "updated_at")
    y = upsert(b, plan.where("direction = 'to_remote'").drop("direction"), keys, "updated_at")
    both = x.withColumnRenamed("value", "v").join(y.withColumnRenamed("value", "w"), keys, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("v").eqNullSafe(F.col("w"))).alias("differing"))


_GAP = 6 * 3600
_SESSIONS_SQL = f"""e AS (SELECT user_id, date_trunc('millisecond', ts) AS beat FROM events), g AS (SELECT *, CASE WHEN epoch_ms(beat) - epoch_ms(lag(beat) OVER w) <= {_GAP * 1000} THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY beat)),
n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY beat ROWS UNBOUNDED PRECEDING) AS session FROM g), s AS (SELECT user_id, session, min(beat) AS began, max(beat) AS ended, count(*) AS n FROM n GROUP BY 1, 2)"""


@query("st3_sessions", f"WITH {_SESSIONS_SQL} SELECT user_id, epoch_ms(began) AS began, epoch_ms(ended) AS ended, n FROM s")
def st3_sessions(spark, sf):
    return T.all_sessions(table(spark, sf, "events"), _GAP).select("user_id", F.unix_millis("began").alias("began"), F.unix_millis("ended").alias("ended"), "n")


@query("st3_session_stream", f"WITH {_SESSIONS_SQL}, m AS (SELECT max(beat) AS now FROM e), l AS (SELECT user_id, max(session) AS last FROM s GROUP BY 1) SELECT user_id, epoch_ms(began) AS began, epoch_ms(ended) AS ended, n FROM s JOIN l USING (user_id) CROSS JOIN m WHERE session < last OR epoch_ms(ended) + {_GAP * 1000} <= epoch_ms(now) - 3600000")
def st3_stream(spark, sf):
    """Sessions as timers end them: of each user's last one, those that the watermark, an hour behind, has passed."""
    stream = S.event_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)
    out = T.run_available(T.expiring_sessions(stream, _GAP, "1 hour"), new_folder(spark, "sessions"), new_folder(spark, "sessions-log"))
    return out.select("user_id", F.unix_millis("began").alias("began"), F.unix_millis("ended").alias("ended"), "n")


@query("st6_stream_sync", "SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def st6_stream(spark, sf):
    """The newest value of each user and type: events stream into a store, then half of them once more under another name."""
    events = table(spark, sf, "events")
    rows = lambda df: df.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("at"))
    store = Store.open(spark, new_folder(spark, "store"), rows(events).schema, ["user_id", "event_type"], "at")
    stream = S.event_stream(spark, f"{sf}/events.parquet*", events.schema)
    sync_available(rows(stream), store, "left", new_folder(spark, "left-log"))
    found = sync_available(rows(stream.where("event_id % 2 = 0")), store, "right", new_folder(spark, "right-log"))
    return found.select("user_id", "event_type", "value")
