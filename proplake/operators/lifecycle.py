"""The listing state machine: validation, replay of requested transitions, and jobs that request them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from proplake.config import LEGAL_TRANSITIONS, REJECT_STATES, STATES
from proplake.functions import patterns as P
from proplake.functions.sequence import bucketed_fold
from proplake.functions.text import strip


def is_legal(source: Column, target: Column) -> Column:
    """Legal by the transition map; an unknown start counts as ``new``; staying put is never legal."""
    start = F.coalesce(source, F.lit("new"))
    rules = [(start == a) & target.isin(bs) for a, bs in LEGAL_TRANSITIONS.items() if bs]
    expr = rules[0]
    for rule in rules[1:]:
        expr = expr | rule
    return F.coalesce(expr, F.lit(False))


def transition_validate(requests: DataFrame, source: str = "from_status", target: str = "to_status") -> DataFrame:
    return requests.withColumn("legal", is_legal(F.col(source), F.col(target)))


def transition_fold(requests: DataFrame, bucket_seconds: float = 86_400.0) -> DataFrame:
    """Replay requests (uid, id, ts, to_status, reason) per listing in (ts, id) order from state ``new``.

    Adds ``from_status`` and ``accepted``; a rejected request leaves the state. What a day of requests does is a map from
    the seven entry states to exit states, so days are summarised in parallel, chained, and replayed in parallel.
    """
    import pandas as pd

    number = {s: i for i, s in enumerate(STATES)}
    allowed = [{number[t] for t in LEGAL_TRANSITIONS[s]} for s in STATES]

    def summarise(batches):
        held, ends = None, []
        for pdf in batches:
            rows = []
            for uid, bucket, status in zip(pdf["uid"], pdf["bucket"], pdf["to_status"]):
                if (uid, bucket) != held:
                    if held:
                        rows.append((*held, ends))
                    held, ends = (uid, bucket), list(range(len(STATES)))
                target = number.get(status)
                if target is not None:
                    ends = [target if target in allowed[e] else e for e in ends]
            yield pd.DataFrame(rows, columns=["uid", "bucket", "ends"])
        if held:
            yield pd.DataFrame([(*held, ends)], columns=["uid", "bucket", "ends"])

    def thread(batches):
        owner, state = None, 0
        for pdf in batches:
            rows = []
            for uid, bucket, ends in zip(pdf["uid"], pdf["bucket"], pdf["ends"]):
                if uid != owner:
                    owner, state = uid, 0
                rows.append((uid, bucket, state))
                state = int(ends[state])
            yield pd.DataFrame(rows, columns=["uid", "bucket", "entry"])

    names = requests.columns
    out_schema = StructType([*requests.schema.fields, StructField("from_status", StringType()), StructField("accepted", BooleanType())])

    def replay(batches):
        held, state = None, 0
        for pdf in batches:
            before, fine = [], []
            for uid, bucket, entry, status in zip(pdf["uid"], pdf["bucket"], pdf["entry"], pdf["to_status"]):
                if (uid, bucket) != held:
                    held, state = (uid, bucket), int(entry)
                target = number.get(status)
                legal = target is not None and target in allowed[state]
                before.append(STATES[state])
                fine.append(legal)
                if legal:
                    state = target
            yield pdf[names].assign(from_status=before, accepted=fine)

    return bucketed_fold(
        requests, order=("ts", "id"), bucket_seconds=bucket_seconds, summarise=summarise,
        summary_schema="uid string, bucket long, ends array<int>", thread=thread, entry_schema="uid string, bucket long, entry int",
        replay=replay, out_schema=out_schema,
    )


def current_states(folded: DataFrame) -> DataFrame:
    """(uid, current_status, last_transition_at, is_active) after replay; reject states deactivate."""
    last = folded.groupBy("uid").agg(
        F.max_by(F.when(F.col("accepted"), F.col("to_status")), F.when(F.col("accepted"), F.struct("ts", "id"))).alias("current_status"),
        F.max(F.when(F.col("accepted"), F.col("ts"))).alias("last_transition_at"))
    status = F.coalesce("current_status", F.lit("new"))
    return last.select("uid", status.alias("current_status"), "last_transition_at", (~status.isin(REJECT_STATES)).alias("is_active"))


def lifecycle_history(folded: DataFrame, uid: str) -> DataFrame:
    """Accepted transitions of one listing, oldest first."""
    return folded.filter((F.col("uid") == uid) & F.col("accepted")).orderBy("ts", "id")


def infer_reason(reasoning: Column) -> Column:
    """Reject reason named by free text: the first matching rule, ``other`` without one, a label tag when empty."""
    rules = [F.when(reasoning.rlike(P.insensitive(p)), tag) for p, tag in P.REJECT_REASONS]
    return F.when(F.coalesce(reasoning, F.lit("")) == "", "sift_v1_label").otherwise(F.coalesce(*rules, F.lit("other")))


def newest_session(labels: DataFrame) -> DataFrame:
    """Labels of the session with the highest id."""
    return labels.filter(F.col("session_id") == labels.agg(F.max("session_id")).scalar())


def bootstrap_from_labels(labels: DataFrame, known: DataFrame) -> DataFrame:
    """Requested transition or skip reason for every label of the newest session; ``known`` is (uid, current_status)."""
    joined = newest_session(labels).join(known.select("uid", "current_status", F.lit(True).alias("_known")), "uid", "left")
    target = F.when(F.col("tier").isin("best", "good"), "contact_queued").when(F.col("tier").isin("bad", "worse"), "triage_reject")
    skip = (
        F.when(target.isNull(), "unknown_tier").when(F.col("_known").isNull(), "not_in_db")
        .when(F.coalesce("current_status", F.lit("new")) != "new", F.concat(F.lit("already_"), F.col("current_status")))
    )
    reason = F.when(target == "triage_reject", infer_reason(F.col("reasoning"))).otherwise("from_sift")
    return joined.select(
        "uid", "tier", skip.alias("skip_reason"), F.when(skip.isNull(), target).alias("to_status"),
        F.when(skip.isNull(), reason).alias("reason"), F.when(skip.isNull(), F.nullif(strip(F.col("reasoning")), F.lit(""))).alias("notes"))


def apply_let_agreed(targets: DataFrame, dry_run: bool = False) -> DataFrame:
    """Plan for re-checked listings (with ``let_agreed``): flag found ones and request the planned state when it is legal."""
    found, planned = F.col("let_agreed"), F.col("planned_status")
    go = F.lit("dry_run_would_transition->") if dry_run else F.lit("transition->")
    action = (
        F.when(~found, "skip").when(planned.isNull(), "skip_no_target")
        .when(is_legal(F.col("current_status"), planned) | F.lit(dry_run), F.concat(go, planned))
        .otherwise(F.concat(F.lit("is_let_agreed=1; skipped illegal transition->"), planned))
    )
    return targets.withColumns({"is_let_agreed": found & F.lit(not dry_run), "action": action})
