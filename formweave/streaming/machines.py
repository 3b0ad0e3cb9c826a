"""State machines over ordered events: one fold for batches (a JVM aggregate) and the same rules for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: States of a transaction, and actions with the states they may start from.
STATES = ("Draft", "Gathering", "Assembled", "Circulating", "PartiallySigned", "FullyExecuted", "ChangesRequested", "Withdrawn")
TERMINAL = ("FullyExecuted", "Withdrawn")


def step(state: dict, action: str, party: str | None) -> tuple[dict, bool]:
    """The next state and whether the event was valid; an invalid one changes nothing. `state` holds state, parties,
    consented and signed (sets)."""
    s, parties, consented, signed = state["state"], state["parties"], state["consented"], state["signed"]
    new = None
    if action == "withdraw" and s not in TERMINAL:
        new = {"state": "Withdrawn"}
    elif action == "start" and s == "Draft" and parties:
        new = {"state": "Gathering"}
    elif action == "consent" and s == "Gathering" and party in parties:
        new = {"consented": consented | {party}}
    elif action == "assemble" and ((s == "Gathering" and consented >= parties) or s == "ChangesRequested"):
        new = {"state": "Assembled"}
    elif action == "circulate" and s == "Assembled":
        new = {"state": "Circulating"}
    elif action == "sign" and s in ("Circulating", "PartiallySigned") and party in parties and party not in signed:
        now = signed | {party}
        new = {"signed": now, "state": "FullyExecuted" if now >= parties else "PartiallySigned"}
    elif action == "request_changes" and s in ("Circulating", "PartiallySigned"):
        new = {"state": "ChangesRequested", "signed": frozenset()}
    return (state | new, True) if new else (state, False)


def fold_transactions(events: DataFrame, parties: DataFrame) -> DataFrame:
    """(txn_id, state, n_signed, n_errors) after all events in the order of seq. A transaction's events are few: they
    are gathered in its row, and rows are folded in Arrow batches."""
    members = parties.groupBy("txn_id").agg(F.array_sort(F.collect_set("party")).alias("parties"))
    logs = events.groupBy("txn_id").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "party"))).alias("log"))

    @F.pandas_udf("state string, n_signed long, n_errors long")
    def fold(log: pd.Series, parties: pd.Series) -> pd.DataFrame:
        out = []
        for steps, of in zip(log, parties, strict=True):
            state, errors = {"state": "Draft", "parties": frozenset(of if of is not None else ()), "consented": frozenset(), "signed": frozenset()}, 0
            for x in steps:
                state, ok = step(state, x["action"], x["party"])
                errors += not ok
            out.append((state["state"], len(state["signed"]), errors))
        return pd.DataFrame(out, columns=["state", "n_signed", "n_errors"])

    return logs.join(members, "txn_id", "left").select("txn_id", fold("log", "parties").alias("f")).select("txn_id", "f.*")


def stream_transactions(events: DataFrame, party_count: int) -> DataFrame:
    """The same machine over a stream of (txn_id, seq, action, party, parties as a comma list); state is kept by key in
    the state store and every micro-batch emits the transactions that changed."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], group) -> Iterator[pd.DataFrame]:
        held = group.get if group.exists else ("Draft", "", "", 0)
        state = {"state": held[0], "consented": frozenset(filter(None, held[1].split(","))), "signed": frozenset(filter(None, held[2].split(",")))}
        errors = held[3]
        rows = pd.concat(list(batches)).sort_values("seq")
        state["parties"] = frozenset(rows["parties"].iloc[0].split(","))
        for action, party in rows[["action", "party"]].itertuples(index=False):
            state, ok = step(state, action, party)
            errors += not ok
        group.update((state["state"], ",".join(sorted(state["consented"])), ",".join(sorted(state["signed"])), errors))
        yield pd.DataFrame([(key[0], state["state"], len(state["signed"]), errors)], columns=["txn_id", "state", "n_signed", "n_errors"])

    return events.groupBy("txn_id").applyInPandasWithState(fold, "txn_id string, state string, n_signed long, n_errors long", "state string, consented string, signed string, errors long", "update", "NoTimeout")


def consume_once(events: DataFrame) -> DataFrame:
    """Webhook events once by id, in the order of seq: (seq, event_id, outcome). Ignored events are not remembered, and
    a blank id is never a repeat."""
    from pyspark.sql import Window

    kind = F.when(F.col("event_name").isin("order_created", "subscription_created"), "issue").when(F.col("event_name").isin("order_refunded", "subscription_expired"), "revoke").otherwise("ignore")
    known = events.withColumn("kind", kind).withColumn("remembered", (F.col("kind") != "ignore") & (F.trim(F.coalesce("event_id", F.lit(""))) != ""))
    nth = F.sum(F.col("remembered").cast("int")).over(Window.partitionBy("event_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    repeat = F.col("remembered") & (F.coalesce(nth, F.lit(0)) > 0)
    return known.select("seq", "event_id", F.when(repeat, "duplicate").otherwise(F.col("kind")).alias("outcome"))


def stop_reasons(steps: DataFrame, most: int = 12) -> DataFrame:
    """(run_id, stop, step, filled, saved) of multi-step runs: the first step with a reason to stop, by priority
    sign-in, needs-you, at-submit, no-next, stuck; max-steps without one. Neither steps nor runs are broadcast: where steps are
    exploded, Spark takes both for no larger than their source."""
    reason = (
        F.when(F.col("auth"), "sign-in").when(F.col("n_required_empty") > 0, "needs-you").when(F.col("submit") & ~F.coalesce("advance", F.lit(False)), "at-submit").when(~F.coalesce("advance", F.lit(False)), "no-next").when(~F.col("moved"), "stuck")
    )
    rows = steps.where(F.col("step") <= most).withColumn("reason", reason)
    first = rows.groupBy("run_id").agg(F.min(F.when(F.col("reason").isNotNull(), F.col("step"))).alias("at"))
    until = rows.hint("merge").join(first, "run_id").where("at IS NULL OR step <= at")
    return until.groupBy("run_id").agg(F.coalesce(F.max_by("reason", "step"), F.lit("max-steps")).alias("stop"), F.max("step").alias("step"), F.sum("filled").alias("filled"), F.sum("saved").alias("saved"))
