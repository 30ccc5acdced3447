"""Subscriptions as a fold of events: rules submitted, confirmed by token, given up."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

STATE = "email string, rules string, pending string, confirmed boolean, confirm_token string, unsubscribe_token string, created_at timestamp, confirmed_at timestamp, unsubscribed_at timestamp, last_seq long"
_FIELDS = [f.split()[0] for f in STATE.split(", ")]
_OUT = f"{STATE}, seq long, outcome string, final boolean"


def token(kind: str, email: Column, seq: Column) -> Column:
    """The token that a submission makes: ``confirm`` ones with each, ``unsubscribe`` ones with the first of an address."""
    return F.substring(F.sha2(F.concat_ws(":", F.lit(kind), email, seq.cast("string")), 256), 1, 24)


def _applied(state: dict | None, event: dict) -> tuple[dict | None, str]:
    """The state after an event, and what is answered."""
    at, kind = event["at"], event["kind"]
    if kind == "submit":
        rules = event["event_rules"]
        if state is None:
            return {"rules": rules, "pending": None, "confirmed": False, "confirm_token": event["made_confirm"], "unsubscribe_token": event["made_unsubscribe"], "created_at": at, "confirmed_at": None, "unsubscribed_at": None}, "created"
        if state["confirmed"] and state["unsubscribed_at"] is None:  # what is in force stays until the change is confirmed
            return state | {"pending": rules, "confirm_token": event["made_confirm"]}, "confirmed-pending"
        outcome = "pending-refreshed" if state["unsubscribed_at"] is None else "resubscribed"
        return state | {"rules": rules, "pending": None, "confirmed": False, "confirm_token": event["made_confirm"], "confirmed_at": None, "unsubscribed_at": None}, outcome
    if state is None or event["token"] != state[f"{kind}_token"]:
        return state, "invalid"
    if kind == "unsubscribe":
        return state | {"unsubscribed_at": state["unsubscribed_at"] or at}, "done"
    if state["unsubscribed_at"] is not None:
        return state, "unsubscribed"
    if state["confirmed"] and state["pending"] is None:
        return state, "confirmed"
    return state | {"rules": state["rules"] if state["pending"] is None else state["pending"], "pending": None, "confirmed": True, "confirmed_at": state["confirmed_at"] or at}, "confirmed"


def _fold(it):
    """Rows come by address and number; the last address's state goes on from batch to batch."""
    email, state, last = None, None, None

    def final():
        return [{"email": email, **state, "last_seq": last, "seq": None, "outcome": None, "final": True}] if state else []

    for batch in it:
        out = []
        for row in batch.to_pylist():
            if row["email"] != email:
                out += final()
                email, state, last = row["email"], None, None
            if row["kind"] == "state":
                state, last = {f: row[f] for f in _FIELDS if f not in ("email", "last_seq")}, row["last_seq"]
            elif last is None or row["seq"] > last:  # else it is counted in already
                state, outcome = _applied(state, row)
                last = row["seq"]
                out.append({"email": email, **dict.fromkeys(_FIELDS[1:]), "seq": row["seq"], "outcome": outcome, "final": False})
        yield _batch(out)
    yield _batch(final())


def _batch(rows: list[dict]) -> pa.RecordBatch:
    types = {"boolean": pa.bool_(), "string": pa.string(), "long": pa.int64(), "timestamp": pa.timestamp("us", "UTC")}
    fields = [f.split() for f in _OUT.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[t]) for n, t in fields], names=[n for n, _ in fields])


def applied(state: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, outcomes) after events (seq, at, kind, email, rules, token), in order of ``seq``, which is unique.

    ``submit`` bears an address and rules, ``confirm`` and ``unsubscribe`` a token alone, which is looked
    up among those that submissions made: unknown ones are invalid. Submissions to a confirmed address
    wait for a new confirmation. Events that a state has counted in (``last_seq``) change nothing, so a
    replay doesn't either.
    """
    submits = events.where("kind = 'submit' and email is not null").select("seq", F.to_timestamp("at").alias("at"), "kind", "email", F.col("rules").alias("event_rules"), F.lit(None).cast("string").alias("token"), token("confirm", F.col("email"), F.col("seq")).alias("made_confirm"), token("unsubscribe", F.col("email"), F.col("seq")).alias("made_unsubscribe"))
    made = submits.select("email", F.explode(F.array("made_confirm", "made_unsubscribe")).alias("token"))
    made = made.unionByName(state.select("email", F.explode(F.array("confirm_token", "unsubscribe_token")).alias("token"))).distinct()
    asked = events.where("kind in ('confirm', 'unsubscribe')").select("seq", F.to_timestamp("at").alias("at"), "kind", "token")
    asked = asked.join(made, "token", "left")
    known = asked.where("email is not null")
    unknown = asked.where("email is null").select("email", "seq", F.lit("invalid").alias("outcome"))
    rows = state.withColumn("kind", F.lit("state")).unionByName(submits, allowMissingColumns=True).unionByName(known, allowMissingColumns=True)
    folded = rows.repartition("email").sortWithinPartitions("email", F.col("seq").asc_nulls_first()).mapInArrow(_fold, _OUT)
    return folded.where("final").select(*_FIELDS), folded.where("not final").select("email", "seq", "outcome").unionByName(unknown)
