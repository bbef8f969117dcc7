"""The listing state machine."""

from __future__ import annotations

from pyspark.sql import functions as F

from proplake.config import LEGAL_TRANSITIONS
from proplake.functions import patterns as P
from proplake.operators import lifecycle as L
from proplake.operators import views
from proplake.operators.gate import is_let_agreed_title
from proplake.plans.registry import query
from proplake.plans.scoring import LET

LEGAL = "({0}||'>'||{1}) IN (" + ",".join(f"'{a}>{b}'" for a, bs in LEGAL_TRANSITIONS.items() for b in bs) + ")"


@query("transition_validate", f"""
SELECT l.uid, t.to_status, {LEGAL.format("coalesce(l.current_status,'new')", 't.to_status')} AS legal
FROM listings l JOIN (SELECT id, to_status FROM transitions) t ON t.id=CAST(l.property_id AS BIGINT)""", "listings", "transitions")
def transition_validate(t):
    asked = t.listings.select("uid", F.col("current_status").alias("from_status"), F.col("property_id").cast("long").alias("id"))
    return L.transition_validate(asked.join(t.transitions.select("id", "to_status"), "id")).select("uid", "to_status", "legal")


FOLD = f"""
steps AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts, id) AS rn FROM transitions),
fold AS (SELECT uid, id, ts, to_status, reason, rn, 'new' AS from_status, {LEGAL.format("'new'", 'to_status')} AS accepted FROM steps WHERE rn=1
 UNION ALL SELECT s.uid, s.id, s.ts, s.to_status, s.reason, s.rn, f.state, {LEGAL.format('f.state', 's.to_status')}
 FROM (SELECT uid, rn, CASE WHEN accepted THEN to_status ELSE from_status END AS state FROM fold) f JOIN steps s ON s.uid=f.uid AND s.rn=f.rn+1)"""


@query("transition_fold", "SELECT uid, id, from_status, to_status, accepted FROM fold", "transitions", ctes=FOLD, recursive=True)
def transition_fold(t):
    return L.transition_fold(t.transitions).select("uid", "id", "from_status", "to_status", "accepted")


@query("transition_final_states", """
SELECT uid, coalesce(status,'new') AS current_status, moved AS last_transition_at, coalesce(status,'new') NOT IN ('triage_reject','final_reject','not_contacted') AS is_active
FROM (SELECT uid, arg_max(to_status, rn) FILTER (WHERE accepted) AS status, max(ts) FILTER (WHERE accepted) AS moved FROM fold GROUP BY uid)""",
       "transitions", ctes=FOLD, recursive=True)
def transition_final_states(t):
    return L.current_states(L.transition_fold(t.transitions))


@query("lifecycle_history", "SELECT id, ts, from_status, to_status, reason FROM fold WHERE uid='7' AND accepted", "transitions", ctes=FOLD, recursive=True)
def lifecycle_history(t):
    return L.lifecycle_history(L.transition_fold(t.transitions.filter("uid = '7'")), "7").select("id", "ts", "from_status", "to_status", "reason")


@query("listing_detail", """
SELECT d.uid, d.portal, d.score, (SELECT string_agg(o.uid||' '||o.portal||' '||coalesce(o.url,''), ',' ORDER BY o.uid) FROM listings o WHERE o.cluster_id=any_value(d.cluster_id) AND o.uid<>d.uid) AS others,
 1+(SELECT count(*) FROM listings o WHERE o.cluster_id=any_value(d.cluster_id) AND o.uid<>d.uid)::INT AS cluster_size, count(f.id) AS n_transitions, string_agg(f.to_status, ',' ORDER BY f.ts, f.id) FILTER (WHERE f.accepted) AS accepted_path
FROM (SELECT * FROM listings WHERE property_id='7') d LEFT JOIN fold f ON f.uid='7' GROUP BY d.uid, d.portal, d.score""", "listings", "transitions", ctes=FOLD, recursive=True)
def listing_detail(t):
    history = L.transition_fold(t.transitions.filter("uid = '7'")).withColumn("uid", F.when(F.col("uid") == "7", "portal_b:7").otherwise(F.col("uid")))
    detail = views.listing_detail(t.listings, "portal_b:7", history, t.listings.select("uid", "portal", "url", "cluster_id"))
    path = F.array_join(F.transform(F.filter("history", lambda h: h["accepted"]), lambda h: h["to_status"]), ",")
    return detail.select("uid", "portal", "score", F.array_join(F.transform("cluster_others", lambda m: F.concat_ws(" ", m["uid"], m["portal"], F.coalesce(m["url"], F.lit("")))), ",").alias("others"), "cluster_size", F.size("history").cast("long").alias("n_transitions"), path.alias("accepted_path"))


REASON = "CASE WHEN coalesce({0},'')='' THEN 'sift_v1_label' " + " ".join(
    f"WHEN regexp_matches({{0}},'(?i){p}') THEN '{tag}'" for p, tag in P.REJECT_REASONS).replace("{0}", "\x00").replace("{", "{{").replace("}", "}}").replace("\x00", "{0}") + " ELSE 'other' END"


@query("infer_reason", f"SELECT uid, {REASON.format('reasoning')} AS reason FROM labelled", "labelled")
def infer_reason(t):
    return t.labelled.select("uid", L.infer_reason(F.col("reasoning")).alias("reason"))


@query("bootstrap_from_labels", f"""
SELECT b.uid, b.tier, skip AS skip_reason, CASE WHEN skip IS NULL THEN target END AS to_status,
 CASE WHEN skip IS NULL THEN CASE WHEN target='triage_reject' THEN {REASON.format('reasoning')} ELSE 'from_sift' END END AS reason,
 CASE WHEN skip IS NULL THEN nullif(trim(reasoning),'') END AS notes FROM (
 SELECT n.*, target, CASE WHEN target IS NULL THEN 'unknown_tier' WHEN l.uid IS NULL THEN 'not_in_db' WHEN coalesce(l.current_status,'new')<>'new' THEN 'already_'||l.current_status END AS skip
 FROM (SELECT *, CASE WHEN tier IN ('best','good') THEN 'contact_queued' WHEN tier IN ('bad','worse') THEN 'triage_reject' END AS target FROM listing_labels WHERE session_id=(SELECT max(session_id) FROM listing_labels)) n
 LEFT JOIN listings l ON l.uid=n.uid) b""", "listing_labels", "listings")
def bootstrap_from_labels(t):
    return L.bootstrap_from_labels(t.listing_labels, t.listings)


@query("bootstrap_skip_counts", """
SELECT skip_reason, count(*) AS n FROM (SELECT CASE WHEN n.tier NOT IN ('best','good','bad','worse') THEN 'unknown_tier' WHEN l.uid IS NULL THEN 'not_in_db'
 WHEN coalesce(l.current_status,'new')<>'new' THEN 'already_'||l.current_status END AS skip_reason
 FROM listing_labels n LEFT JOIN listings l ON l.uid=n.uid WHERE n.session_id=(SELECT max(session_id) FROM listing_labels)) WHERE skip_reason IS NOT NULL GROUP BY skip_reason""",
       "listing_labels", "listings")
def bootstrap_skip_counts(t):
    plan = L.bootstrap_from_labels(t.listing_labels, t.listings)
    return plan.filter("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


TARGETS = f"""targets AS (SELECT *, coalesce({LET},FALSE) AS let_agreed, CASE WHEN current_status IN ('contact_queued','contacted') THEN 'not_contacted' ELSE 'triage_reject' END AS planned
FROM listings WHERE is_active AND (current_status IN ('contact_queued','contacted') OR ((current_status IS NULL OR current_status='new') AND score>=85)))"""


@query("apply_let_agreed", f"""
SELECT uid, let_agreed AS is_let_agreed, CASE WHEN NOT let_agreed THEN 'skip' WHEN {LEGAL.format("coalesce(current_status,'new')", 'planned')} THEN 'transition->'||planned
 ELSE 'is_let_agreed=1; skipped illegal transition->'||planned END AS action FROM targets""", "listings", ctes=TARGETS)
def apply_let_agreed(t):
    targets = views.recheck_targets(t.listings).withColumn("let_agreed", is_let_agreed_title(F.col("title")))
    return L.apply_let_agreed(targets).select("uid", "is_let_agreed", "action")
