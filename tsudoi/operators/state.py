"""State merges: each takes table versions in and gives new versions and outcomes out.

Nothing is updated in place; a rerun with the same input changes nothing. Where an order matters it
is an explicit ``seq`` column. New ids are ``max(id) + seq``, so no global counter is needed.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsudoi.functions import canon, classify, feeddates, images, place
from tsudoi.functions.text import blank_to_null, nfkc, strip
from tsudoi.functions.urls import source_event_id
from tsudoi.operators.claims import first_claims
from tsudoi.operators.importing import draft_refusal
from tsudoi.operators.lookups import already_attached, missing_occurrences
from tsudoi.plans.ranking import top_k
from tsudoi.session import dealt

PROTECTED = ("published", "hidden")
RESOLVED = ("linked", "created", "rejected", "expired")
DECIDED = ("accepted", "rejected", "expired")


def _same(keys: Sequence[str], left: str = "", right: str = "_k_") -> Column:
    cond = None
    for k in keys:
        part = F.col(left + k).eqNullSafe(F.col(right + k))
        cond = part if cond is None else cond & part
    return cond


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str], guard: Column | None = None, keep_old_if_null: Sequence[str] = ()) -> DataFrame:
    """S7. A new version of ``current``: matched rows take the incoming columns where ``guard`` (over the
    current row) holds, unmatched incoming rows are added, all others stay. ``incoming`` has one row per key."""
    cols = current.columns
    given = [c for c in cols if c in incoming.columns]
    inc = incoming.select(*[F.col(c).alias("_k_" + c) for c in given], F.lit(True).alias("_new"))
    joined = current.withColumn("_old", F.lit(True)).join(inc, _same(keys), "full_outer")
    take = F.col("_new").isNotNull() & (F.col("_old").isNull() | (F.lit(True) if guard is None else F.coalesce(guard, F.lit(False))))

    def value(c: str) -> Column:
        if c not in given:
            return F.col(c)
        new = F.coalesce("_k_" + c, c) if c in keep_old_if_null else F.col("_k_" + c)
        return F.when(take, new).otherwise(F.col(c)).alias(c)

    return joined.select(*[value(c) if c in given else F.col(c) for c in cols])


def _next_id(table: DataFrame, seq: Column) -> Column:
    return table.agg(F.coalesce(F.max("id"), F.lit(0))).scalar() + seq


# ---- routing and sources ----------------------------------------------------------------------------
def route_import(incoming: DataFrame, decisions: DataFrame, events: DataFrame) -> DataFrame:
    """M1. One action per incoming row.

    review (likely/ambiguous) · attach_and_diff or attach (exact, by protection) · draft_update or
    slug_protected (no match, slug known) · skip_invalid · create_draft. ``incoming`` carries seq and slug."""
    matched = events.select(F.col("id").alias("matched_id"), F.col("status").alias("_ms"))
    by_slug = events.groupBy("slug").agg(F.min(F.struct("id", "status")).alias("_s"))
    rows = incoming.join(decisions.select("seq", "duplicate_status", "matched_id"), "seq").join(dealt(matched), "matched_id", "left").join(dealt(by_slug), "slug", "left")
    refusal = draft_refusal(F.col("title"), F.col("source_url"), F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    action = (F.when(strip(F.coalesce("source_url", F.lit(""))) == "", "skip_invalid").when(F.col("duplicate_status").isin("likely", "ambiguous"), "review")
              .when(F.col("duplicate_status") == "exact", F.when(F.col("_ms").isNull(), "error_event_missing").when(F.col("_ms").isin(*PROTECTED), "attach_and_diff").otherwise("attach"))
              .when(refusal.isNotNull(), "skip_invalid").when(F.col("_s.status") == "draft", "draft_update").when(F.col("_s.id").isNotNull(), "slug_protected").otherwise("create_draft"))
    target = F.when(F.col("duplicate_status") == "none", F.col("_s.id")).otherwise(F.col("matched_id"))
    return rows.withColumns({"action": action, "event_id": target}).drop("_ms", "_s", "matched_id")


SOURCE_KEY = ("event_id", "source_name", "source_url")


def attach_outcome(sources: DataFrame, attaches: DataFrame) -> DataFrame:
    """M2. (keys, outcome) per distinct source: new_source or already_attached."""
    have = sources.select(*SOURCE_KEY, F.lit(True).alias("_have")).distinct()
    want = attaches.select(*SOURCE_KEY).distinct()
    return want.join(have, list(SOURCE_KEY), "left").withColumn("outcome", F.when(F.col("_have"), "already_attached").otherwise("new_source")).drop("_have")


def attach_sources(sources: DataFrame, attaches: DataFrame) -> DataFrame:
    """M2. Known sources get the new check time, official URL and feed id; others are added. The last row per key counts."""
    last = attaches.groupBy(*SOURCE_KEY).agg(F.max_by(F.struct("source_event_id", "official_url", "last_checked_at"), "seq").alias("x")).select(*SOURCE_KEY, "x.*")
    return upsert(sources, last, SOURCE_KEY)


REVIEW_KEY = ("source_name", "source_url", "candidate_event_id")


def dedupe_review_outcome(reviews: DataFrame, incoming: DataFrame) -> DataFrame:
    """M3. Adds outcome and review_id to incoming(seq, keys, duplicate_status, reason, payload).

    A resolved review is never reopened; a pending one is refreshed; a null candidate equals a null candidate."""
    order = F.when(F.col("status").isin(*RESOLVED), 0).when(F.col("status") == "pending", 1).otherwise(2)
    best = reviews.groupBy(*REVIEW_KEY).agg(F.min(F.struct(order.alias("o"), "id", "status")).alias("_b"))
    rows = incoming.join(best.select(*[F.col(k).alias("_k_" + k) for k in REVIEW_KEY], "_b"), _same(REVIEW_KEY), "left").drop(*["_k_" + k for k in REVIEW_KEY])
    invalid = (strip(F.coalesce("source_url", F.lit(""))) == "") | ~F.col("duplicate_status").isin("likely", "ambiguous")
    outcome = F.when(invalid, "skipped_invalid").when(F.col("_b.o") == 0, "skipped_resolved").when(F.col("_b.o") == 1, "updated_pending").otherwise("inserted")
    return rows.withColumns({"outcome": outcome, "review_id": F.col("_b.id")}).drop("_b")


def upsert_dedupe_reviews(reviews: DataFrame, incoming: DataFrame) -> DataFrame:
    """M3. New version of the review table. Of several incoming rows with one key the last counts."""
    rows = dedupe_review_outcome(reviews, incoming)
    last = rows.where(F.col("outcome").isin("inserted", "updated_pending")).groupBy(*REVIEW_KEY).agg(
        F.max_by(F.struct("seq", "outcome", "review_id", "duplicate_status", "reason", "payload", "scores"), "seq").alias("x")).select(*REVIEW_KEY, "x.*")
    fresh = last.where(F.col("outcome") == "updated_pending").select(F.col("review_id").alias("id"), *[F.col(c).alias("_" + c) for c in ("duplicate_status", "reason", "payload", "scores")], F.lit(True).alias("_hit"))
    kept = reviews.join(fresh, "id", "left")
    for c in ("duplicate_status", "reason", "payload", "scores"):
        kept = kept.withColumn(c, F.when(F.col("_hit"), F.col("_" + c)).otherwise(F.col(c)))
    added = last.where(F.col("outcome") == "inserted").select(
        _next_id(reviews, F.col("seq")).alias("id"), F.lit("pending").alias("status"), *REVIEW_KEY, "duplicate_status", "reason", "payload", "scores")
    return kept.select(*reviews.columns).unionByName(added, allowMissingColumns=True).select(*reviews.columns)


# ---- field reviews ----------------------------------------------------------------------------------
def field_diffs(proposed: DataFrame, current: DataFrame) -> DataFrame:
    """M4. Long diffs of proposed(event_id, source_name, source_url, seq, fields...) against current(id, fields...).

    The current side is made canonical once per event, before the join; of a proposal only the fields whose raw value is
    another one. The wide rows meet once on the event; the diffs are an array built in one projection, so the fields are never
    shuffled one by one. A null proposal proposes nothing."""
    fields = [f for f in canon.REVIEWABLE if f in proposed.columns and f in current.columns]
    raw = lambda f, col: col if canon.FIELD_KINDS[f] == "tags" else col.cast("string")
    now = current.select(F.col("id").alias("event_id"), *[raw(f, F.col(f)).alias("_r_" + f) for f in fields], *[canon.canonical(f, F.col(f), "store").alias("_cs_" + f) for f in fields])
    now = now.select("event_id", *["_r_" + f for f in fields], *[canon.canonical_json(f, F.col("_cs_" + f)).alias("_cs_" + f) for f in fields],
                     *[canon.canonical_json(f, canon.canonical(f, F.col("_cs_" + f), "compare")).alias("_ck_" + f) for f in fields])
    step = proposed.join(now, "event_id")
    other = lambda f: F.col(f).isNotNull() & ~raw(f, F.col(f)).eqNullSafe(F.col("_r_" + f))
    step = step.withColumns({"_ps_" + f: F.when(other(f), canon.canonical(f, F.col(f), "store")) for f in fields})
    step = step.withColumns({"_pk_" + f: F.when(F.col("_ps_" + f).isNotNull(), canon.canonical_json(f, canon.canonical(f, F.col("_ps_" + f), "compare"))) for f in fields})

    def diff(f: str) -> Column:
        p, c = F.col("_pk_" + f), F.col("_ck_" + f)
        return F.when(p.isNotNull() & ~p.eqNullSafe(c), F.struct(
            F.lit(f).alias("field_name"), F.col("_cs_" + f).alias("current_value"), canon.canonical_json(f, F.col("_ps_" + f)).alias("proposed_value"),
            canon.proposal_hash(f, p).alias("proposal_hash"), F.concat(F.lit(f), F.when(c.isNull(), ": null → value").otherwise(": value changed")).alias("reason")))

    return step.select("seq", "event_id", "source_name", "source_url", F.explode(F.array_compact(F.array(*[diff(f) for f in fields]))).alias("d")).select(
        "seq", "event_id", "source_name", "source_url", "d.*")


PROPOSAL = ("event_id", "source_name", "field_name")


def field_review_outcome(reviews: DataFrame, diffs: DataFrame, events: DataFrame) -> DataFrame:
    """M5. Diffs of protected events with outcome: already_<status>, updated or created, and the review they meet."""
    key = [*PROPOSAL, "proposal_hash"]
    first = reviews.groupBy(*key).agg(F.min(F.struct("id", "status")).alias("_r"))
    guarded = diffs.join(events.where(F.col("status").isin(*PROTECTED)).select(F.col("id").alias("event_id")), "event_id", "left_semi")
    outcome = F.when(F.col("_r.status").isin(*DECIDED), F.concat(F.lit("already_"), F.col("_r.status"))).when(F.col("_r.status") == "pending", "updated").otherwise("created")
    return guarded.join(first, key, "left").withColumns({"outcome": outcome, "review_id": F.col("_r.id")}).drop("_r")


def sync_field_reviews(reviews: DataFrame, diffs: DataFrame, events: DataFrame) -> DataFrame:
    """M5. New version of the field reviews. A created proposal expires every other pending one of its field;
    of several new ones in a batch the last by seq stays pending. Decided proposals never come back."""
    rows = field_review_outcome(reviews, diffs, events)
    key = [*PROPOSAL, "proposal_hash"]
    created = rows.where(F.col("outcome") == "created").groupBy(*key).agg(F.max_by(F.struct("seq", "source_url", "current_value", "proposed_value", "reason"), "seq").alias("x")).select(*key, "x.*")
    winner = created.groupBy(*PROPOSAL).agg(F.max_by("proposal_hash", "seq").alias("_win"))
    refreshed = rows.where(F.col("outcome") == "updated").groupBy(F.col("review_id").alias("id")).agg(
        F.max_by(F.struct("source_url", "current_value", "proposed_value", "reason"), "seq").alias("_u"))
    kept = reviews.join(refreshed, "id", "left").join(winner, list(PROPOSAL), "left")
    expire = (F.col("status") == "pending") & F.col("_win").isNotNull() & (F.col("proposal_hash") != F.col("_win"))
    for c in ("source_url", "current_value", "proposed_value"):
        kept = kept.withColumn(c, F.when(F.col("_u").isNotNull(), F.col("_u." + c)).otherwise(F.col(c)))
    kept = kept.withColumns({"reason": F.when(expire, "superseded_by_new_proposal").when(F.col("_u").isNotNull(), F.col("_u.reason")).otherwise(F.col("reason")),
                             "status": F.when(expire, "expired").otherwise(F.col("status"))})
    added = created.join(winner, list(PROPOSAL)).select(
        (_next_id(reviews, F.col("seq") * len(canon.REVIEWABLE)) + F.array_position(F.array(*[F.lit(f) for f in canon.REVIEWABLE]), F.col("field_name"))).alias("id"), *key,
        "source_url", "current_value", "proposed_value", F.when(F.col("proposal_hash") == F.col("_win"), F.col("reason")).otherwise("superseded_by_new_proposal").alias("reason"),
        F.when(F.col("proposal_hash") == F.col("_win"), "pending").otherwise("expired").alias("status"))
    return kept.select(*reviews.columns).unionByName(added, allowMissingColumns=True).select(*reviews.columns)


# ---- drafts and occurrences ---------------------------------------------------------------------------
def update_drafts(events: DataFrame, updates: DataFrame) -> DataFrame:
    """M6. Draft bodies take the update; price text, price type and kids flag only when given; a new picture
    resets its rights. Other statuses are left alone. ``updates`` has one row per id."""
    cols = [c for c in updates.columns if c != "id" and c in events.columns]
    u = updates.select("id", *[F.col(c).alias("_u_" + c) for c in cols], F.lit(True).alias("_hit"))
    joined = events.join(u, "id", "left").withColumn("_ok", F.coalesce(F.col("_hit") & (F.col("status") == "draft"), F.lit(False)))
    if "image_url" in cols:
        moved = F.col("_ok") & ~F.col("_u_image_url").eqNullSafe(F.col("image_url"))
        joined = joined.withColumn("image_usage_status", F.when(moved, "unknown").otherwise(F.col("image_usage_status")))
    careful = ("price_text", "price_type", "is_kids")
    for c in cols:
        joined = joined.withColumn(c, F.when(F.col("_ok"), F.coalesce("_u_" + c, c) if c in careful else F.col("_u_" + c)).otherwise(F.col(c)))
    return joined.select(*events.columns)


def fill_occurrences(occurrences: DataFrame, incoming: DataFrame, events: DataFrame) -> DataFrame:
    """M7. Adds the sessions that are missing, only for events whose body is not protected."""
    open_ids = events.where(~F.col("status").isin(*PROTECTED)).select(F.col("id").alias("event_id"))
    missing = missing_occurrences(incoming.join(open_ids, "event_id", "left_semi"), occurrences)
    return occurrences.unionByName(missing, allowMissingColumns=True)


# ---- decisions ----------------------------------------------------------------------------------------
def dedupe_decision_outcome(decisions: DataFrame, reviews: DataFrame, events: DataFrame, sources: DataFrame) -> DataFrame:
    """M8. decisions(seq, review_id, intent link|create|reject) with outcome and, for errors, the reason.

    Reviews carry the incoming title, dates and URL as columns. Only the first decision of a review counts.
    Decisions are taken in order of seq: a link attaches its URL, so a later create with it is refused; a create
    claims its URL and slug only if it succeeds. Failed rows leave their review pending."""
    first = decisions.groupBy("review_id").agg(F.min("seq").alias("_first"))
    r = reviews.select(F.col("id").alias("review_id"), F.col("status").alias("_status"), "source_name", "source_url", "candidate_event_id", "title", "start_date", "end_date")
    rows = decisions.join(first, "review_id").join(r, "review_id", "left")
    rows = rows.join(events.select(F.col("id").alias("candidate_event_id"), F.lit(True).alias("_cand")), "candidate_event_id", "left")
    rows = rows.join(sources.select("source_name", "source_url", F.lit(True).alias("_attached")).distinct(), ["source_name", "source_url"], "left")
    rows = rows.withColumn("slug", canon.draft_slug(F.col("source_name"), source_event_id(F.col("source_url")), F.col("title"), F.col("start_date"), F.col("source_url")))
    rows = rows.join(events.select("slug", F.lit(True).alias("_slug")).distinct(), "slug", "left")
    refusal = draft_refusal(F.col("title"), F.col("source_url"), F.col("start_date").cast("string"), F.col("end_date").cast("string"))
    base = (F.when(F.col("_status").isNull(), "review_not_found").when((F.col("_status") != "pending") | (F.col("seq") != F.col("_first")), "review_not_pending")
            .when((F.col("intent") == "link") & F.col("_cand").isNull(), "candidate_missing").when((F.col("intent") == "create") & refusal.isNotNull(), refusal)
            .when((F.col("intent") == "create") & F.col("_attached"), "url_already_attached").when((F.col("intent") == "create") & F.col("_slug"), "slug_exists"))
    rows = rows.withColumn("error", base)
    live = rows.where(F.col("error").isNull() & (F.col("intent") == "create"))
    # a create that an earlier link or successful create forestalls fails and claims neither its URL nor its slug
    linked = rows.where(F.col("error").isNull() & (F.col("intent") == "link")).groupBy("source_name", "source_url").agg(F.min("seq").alias("_l"))
    live = live.join(linked, ["source_name", "source_url"], "left").where(F.coalesce(F.col("seq") < F.col("_l"), F.lit(True)))
    keys = live.select("seq", F.explode(F.array_compact(F.array(F.concat_ws("|", F.lit("u"), "source_name", "source_url"), F.concat(F.lit("s|"), "slug")))).alias("key"))
    made = live.join(first_claims(live, keys).where("won"), "seq", "left_semi")
    by_url = made.select("source_name", "source_url", F.col("seq").alias("_at")).unionByName(linked.withColumnRenamed("_l", "_at")).groupBy("source_name", "source_url").agg(F.min("_at").alias("_u"))
    by_slug = made.select("slug", F.col("seq").alias("_s"))
    rows = rows.join(by_url, ["source_name", "source_url"], "left").join(by_slug, "slug", "left")
    late = F.col("error").isNull() & (F.col("intent") == "create")
    error = F.when(late & (F.col("seq") > F.col("_u")), "url_already_attached").when(late & (F.col("seq") > F.col("_s")), "slug_exists").otherwise(F.col("error"))
    done = F.create_map(*[F.lit(x) for kv in (("link", "linked"), ("create", "created"), ("reject", "rejected")) for x in kv])
    rows = rows.withColumn("error", error).withColumn("outcome", F.when(F.col("error").isNull(), done[F.col("intent")]).otherwise("error"))
    event = F.when(F.col("outcome") == "linked", F.col("candidate_event_id")).when(F.col("outcome") == "created", _next_id(events, F.col("seq")))
    return rows.select("seq", "review_id", "intent", "outcome", "error", event.alias("event_id"), "source_name", "source_url", "title", "start_date", "end_date", "slug")


def apply_dedupe_decisions(outcome: DataFrame, reviews: DataFrame, events: DataFrame, sources: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M8. New versions of reviews, events and sources. Linking never touches the event body."""
    ok = outcome.where(F.col("outcome") != "error")
    mark = ok.select(F.col("review_id").alias("id"), F.col("outcome").alias("_o"), F.col("event_id").alias("_e"))
    new_reviews = reviews.join(mark, "id", "left").withColumns({
        "status": F.coalesce("_o", "status"), "resolved_event_id": F.when(F.col("_o").isNotNull(), F.col("_e")).otherwise(F.col("resolved_event_id"))}).select(*reviews.columns)
    drafts = ok.where(F.col("outcome") == "created").select(F.col("event_id").alias("id"), "slug", "title", F.lit("draft").alias("status"), "start_date", "end_date", "source_url")
    new_events = events.unionByName(drafts, allowMissingColumns=True).select(*events.columns)
    attaches = ok.where(F.col("outcome") != "rejected").select("seq", "event_id", "source_name", "source_url", source_event_id(F.col("source_url")).alias("source_event_id"),
                                                              F.lit(None).cast("string").alias("official_url"), now.alias("last_checked_at"))
    return new_reviews, new_events, attach_sources(sources, attaches)


def field_decision_outcome(decisions: DataFrame, reviews: DataFrame, events: DataFrame) -> DataFrame:
    """M9. decisions(seq, review_id, intent accept|reject): accepted, rejected or the reason it failed.
    Accepting needs a published event and an allowed field; only the first decision of a review counts."""
    first = decisions.groupBy("review_id").agg(F.min("seq").alias("_first"))
    r = reviews.select(F.col("id").alias("review_id"), "event_id", "field_name", "proposed_value", F.col("status").alias("_status"))
    e = events.select(F.col("id").alias("event_id"), F.col("status").alias("_es"))
    rows = decisions.join(first, "review_id").join(r, "review_id", "left").join(e, "event_id", "left")
    accept = F.col("intent") == "accept"
    outcome = (F.when(F.col("_status").isNull(), "review_not_found").when((F.col("_status") != "pending") | (F.col("seq") != F.col("_first")), "review_not_pending")
               .when(accept & ~F.col("field_name").isin(*canon.REVIEWABLE), "field_not_allowed").when(accept & ~F.col("_es").eqNullSafe(F.lit("published")), "event_not_published")
               .when(accept, "accepted").otherwise("rejected"))
    return rows.withColumn("outcome", outcome).select("seq", "review_id", "intent", "event_id", "field_name", "proposed_value", "outcome")


def apply_field_decisions(outcome: DataFrame, reviews: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M9. New versions of reviews and events; of several accepts of one field the last review id wins."""
    marks = outcome.where(F.col("outcome").isin("accepted", "rejected")).select(F.col("review_id").alias("id"), F.col("outcome").alias("_o"))
    new_reviews = reviews.join(marks, "id", "left").withColumn("status", F.coalesce("_o", "status")).select(*reviews.columns)
    fields = [f for f in canon.REVIEWABLE if f in events.columns]
    last = outcome.where(F.col("outcome") == "accepted").groupBy("event_id", "field_name").agg(F.max_by("proposed_value", "review_id").alias("v"))
    wide = last.groupBy(F.col("event_id").alias("id")).agg(*[F.max(F.when(F.col("field_name") == f, F.col("v"))).alias("_v_" + f) for f in fields])
    joined = events.join(wide, "id", "left")
    for f in fields:
        raw = F.col("_v_" + f)
        kind = events.schema[f].dataType.simpleString()
        value = F.from_json(raw, kind) if kind.startswith("array") else F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v").try_cast(kind)
        joined = joined.withColumn(f, F.when(raw.isNotNull(), value).otherwise(F.col(f)))
    return new_reviews, joined.select(*events.columns)


# Allowed status changes.
TRANSITIONS = {"publish": ("draft", "published"), "hide": ("published", "hidden"), "unhide": ("hidden", "published")}


def status_outcome(requests: DataFrame, events: DataFrame) -> DataFrame:
    """M10. requests(seq, id, intent): done, not_found or wrong_status. The first request per event counts."""
    rows = top_k(requests, ["id"], [F.col("seq")], 1, "_f").drop("_f").join(events.select("id", F.col("status").alias("_s")), "id", "left")
    need = F.create_map(*[F.lit(x) for k, (a, _) in TRANSITIONS.items() for x in (k, a)])
    outcome = (F.when(F.col("_s").isNull(), "not_found").when(F.col("intent") == "delete", "done").when(need[F.col("intent")] == F.col("_s"), "done").otherwise("wrong_status"))
    return rows.withColumn("outcome", outcome).drop("_s")


def apply_status(requests: DataFrame, events: DataFrame) -> DataFrame:
    """M10. New event table; deleted events are gone."""
    ok = status_outcome(requests, events).where(F.col("outcome") == "done").select("id", F.col("intent").alias("_i"))
    to = F.create_map(*[F.lit(x) for k, (_, b) in TRANSITIONS.items() for x in (k, b)])
    joined = events.join(ok, "id", "left").where(~F.col("_i").eqNullSafe(F.lit("delete")))
    return joined.withColumn("status", F.coalesce(to[F.col("_i")], "status")).select(*events.columns)


def cascade_delete(child: DataFrame, deleted: DataFrame, fk: str = "event_id") -> DataFrame:
    """M10. Child rows of deleted events are gone too."""
    return child.join(deleted.select(F.col("id").alias(fk)), fk, "left_anti")


def set_image_rights(events: DataFrame, ids: DataFrame, status: str, credit: str | None = None) -> DataFrame:
    """M11. Sets the rights of the given ids; a credit stays only for licensed or granted pictures."""
    hit = events.join(ids.select("id", F.lit(True).alias("_hit")).distinct(), "id", "left")
    keep = F.lit(credit if status in ("licensed", "organizer_granted") else None).cast("string")
    return hit.withColumns({"image_usage_status": F.when(F.col("_hit"), status).otherwise(F.col("image_usage_status")),
                            "image_credit": F.when(F.col("_hit"), keep).otherwise(F.col("image_credit"))}).select(*events.columns)


def classify_approvals(requested: DataFrame, rows: DataFrame) -> DataFrame:
    """M12. requested(seq, id) with approved: pending with a picture URL. Request order stays in seq."""
    r = rows.select("id", F.coalesce(blank_to_null(strip(F.col("generated_image_status"))), F.lit("none")).alias("_s"), blank_to_null(strip(F.col("generated_image_url"))).alias("_u"))
    ok = F.coalesce((F.col("_s") == "pending") & F.col("_u").isNotNull(), F.lit(False))
    return requested.join(r, "id", "left").withColumn("approved", ok).drop("_s", "_u")


def summary_save_outcome(summaries: DataFrame, saves: DataFrame) -> DataFrame:
    """M13. saves(seq, event_id, intent save|publish|hide, bullets, forced): what happens to each.
    A published or hidden summary is not overwritten by a save unless forced; publishing needs bullets."""
    cur = summaries.select("event_id", F.col("status").alias("_s"), F.col("bullets").alias("_b"))
    rows = saves.join(cur, "event_id", "left")
    bullets = F.size(F.filter(F.coalesce("bullets", "_b", F.array().cast("array<string>")), lambda b: strip(b) != ""))
    outcome = (F.when(F.col("intent") == "save", F.when(F.col("_s").isin(*PROTECTED) & ~F.col("forced"), "refused_protected").when(F.col("_s").isNull(), "created_draft").otherwise("saved_draft"))
               .when(F.col("intent") == "publish", F.when(bullets == 0, "refused_no_bullets").otherwise("published"))
               .when(F.col("_s").isNull(), "refused_missing").otherwise("hidden"))
    return rows.withColumn("outcome", outcome).drop("_s", "_b")


def save_summaries(summaries: DataFrame, saves: DataFrame) -> DataFrame:
    """M13. New version of the summaries, one row per event: of several accepted saves the last by seq wins, and
    bullets it doesn't give come from the last save that does."""
    ok = summary_save_outcome(summaries, saves).where(~F.col("outcome").startswith("refused"))
    given = F.when(F.col("bullets").isNotNull(), F.col("seq"))
    ok = ok.groupBy("event_id").agg(F.max_by("outcome", "seq").alias("outcome"), F.max_by("bullets", given).alias("bullets"))
    status = F.when(F.col("outcome") == "published", "published").when(F.col("outcome") == "hidden", "hidden").otherwise("draft")
    new = ok.select("event_id", status.alias("status"), "bullets")
    return upsert(summaries, new, ["event_id"], keep_old_if_null=["bullets"])


def open_translation_drafts(translations: DataFrame, drafts: DataFrame, events: DataFrame) -> DataFrame:
    """M14. The drafts(seq, event_id, locale, forced) that may be saved: the event exists, and a published or hidden
    translation of that locale stays unless the draft is forced."""
    prot = translations.where(F.col("status").isin(*PROTECTED)).select("event_id", "locale", F.lit(True).alias("_p"))
    known = drafts.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return known.join(prot, ["event_id", "locale"], "left").where(F.col("_p").isNull() | F.col("forced")).drop("_p")


def save_translations(translations: DataFrame, drafts: DataFrame, events: DataFrame, fields: Sequence[str] = ("title", "summary")) -> DataFrame:
    """M14. Drafts(seq, event_id, locale, forced); protected translations stay unless forced, and a field the
    original leaves empty is emptied. Of several drafts of one (event_id, locale) that may be saved the last wins."""
    src = events.select(F.col("id").alias("event_id"), *[F.col(f).alias("_src_" + f) for f in fields])
    masked = open_translation_drafts(translations, drafts, events).join(src, "event_id")
    for f in fields:
        masked = masked.withColumn(f, F.when(F.coalesce(strip(F.col("_src_" + f)), F.lit("")) != "", F.col(f)))
    last = top_k(masked.withColumn("status", F.lit("draft")), ["event_id", "locale"], [F.col("seq").desc()], 1, "_r")
    return upsert(translations, last.select("event_id", "locale", "status", *fields), ["event_id", "locale"])


def said_bullets(bullets: Column, most: int | None = None) -> Column:
    """Trimmed bullets that say something, the first ``most`` of them."""
    said = F.filter(F.transform(F.coalesce(bullets, F.array().cast("array<string>")), strip), lambda b: F.coalesce(b != "", F.lit(False)))
    return said if most is None else F.slice(said, 1, most)


# Fixed value: bullets of a summary that are translated.
TRANSLATED_BULLETS = 5


def reaction_translation_outcome(translations: DataFrame, drafts: DataFrame, events: DataFrame, summaries: DataFrame, stored: DataFrame) -> DataFrame:
    """M14. drafts(seq, event_id, locale, forced, with_reaction, bullets) with summary_id and outcome.

    A reaction translation is only saved together with the event's own (``translations``), from the event's published summary
    (``summaries``: id, event_id, status, bullets) with bullets; one that is published or hidden (``stored``: summary_id,
    locale, status, bullets) stays unless forced. An event has one summary; of several published ones the last id counts."""
    allowed = open_translation_drafts(translations, drafts, events).select("seq", F.lit(True).alias("_open"))
    shown = summaries.where(F.col("status") == "published").groupBy("event_id").agg(F.max("id").alias("summary_id"), F.max_by("bullets", "id").alias("_said"))
    old = stored.select("summary_id", "locale", F.col("status").alias("_s"))
    rows = drafts.join(allowed, "seq", "left").join(shown, "event_id", "left").join(old, ["summary_id", "locale"], "left")
    outcome = (F.when(~F.coalesce("with_reaction", F.lit(False)), "not_asked").when(F.col("_open").isNull(), "event_translation_refused")
               .when(F.col("summary_id").isNull(), "no_published_summary").when(F.col("_s").isin(*PROTECTED) & ~F.col("forced"), "refused_protected")
               .when(F.size(said_bullets(F.col("_said"), TRANSLATED_BULLETS)) == 0, "no_bullets").when(F.col("_s").isNull(), "created_draft").otherwise("saved_draft"))
    return rows.withColumn("outcome", outcome).select(*drafts.columns, "summary_id", "outcome")


def save_reaction_translations(translations: DataFrame, drafts: DataFrame, events: DataFrame, summaries: DataFrame, stored: DataFrame) -> DataFrame:
    """M14. New version of ``stored``: accepted drafts become draft translations of the summary; the last by seq wins."""
    rows = reaction_translation_outcome(translations, drafts, events, summaries, stored).where(F.col("outcome").isin("created_draft", "saved_draft"))
    last = rows.groupBy("summary_id", "locale").agg(F.max_by("bullets", "seq").alias("bullets"))
    new = last.select("summary_id", "locale", F.lit("draft").alias("status"), said_bullets(F.col("bullets"), TRANSLATED_BULLETS).alias("bullets"))
    return upsert(stored, new, ["summary_id", "locale"])


def backfill_municipality(events: DataFrame) -> DataFrame:
    """M15. Published rows without a municipality get the inferred one; the area stays."""
    step = place.with_municipality(events, out="_m")
    empty = blank_to_null(strip(F.col("municipality"))).isNull()
    return step.withColumn("municipality", F.when((F.col("status") == "published") & empty, F.coalesce("_m", "municipality")).otherwise(F.col("municipality"))).select(*events.columns)


def clear_duplicate_area(events: DataFrame) -> DataFrame:
    """M16. Published rows whose area only repeats the municipality lose the area."""
    dup = (F.col("status") == "published") & (F.col("area") == F.col("municipality"))
    return events.withColumn("area", F.when(F.coalesce(dup, F.lit(False)), None).otherwise(F.col("area")))


def backfill_image_source(events: DataFrame, hosts: Mapping[str, str]) -> DataFrame:
    """M16. Pictures without rights become 'unknown', with the source named by host pattern."""
    has = F.coalesce(strip(F.col("image_url")) != "", F.lit(False)) & F.col("image_usage_status").isNull()
    source = F.lit("other")
    for pattern, name in reversed(list(hosts.items())):
        source = F.when(F.col("image_url").ilike(pattern), name).otherwise(source)
    return events.withColumns({"image_source": F.when(has, source), "image_usage_status": F.when(has, "unknown").otherwise(F.col("image_usage_status"))})


def summary_fill_route(summaries: DataFrame, events: DataFrame, sources: DataFrame, source_name: str) -> DataFrame:
    """M21. Proposed summaries for events of one feed whose summary is empty: write (draft), review (published) or skip."""
    linked = sources.where(F.col("source_name") == source_name).select(F.col("event_id").alias("id")).distinct()
    rows = summaries.join(events.select("id", "status", F.col("summary").alias("_cur")), "id").join(linked, "id", "left_semi")
    empty = blank_to_null(strip(F.col("_cur"))).isNull()
    route = F.when(~empty, "skip_filled").when(F.col("status") == "draft", "write").when(F.col("status") == "published", "review").otherwise("skip_status")
    return rows.withColumn("route", route).drop("_cur")


def plan_batch(incoming: DataFrame, sources: DataFrame, decisions: DataFrame, today: Column) -> DataFrame:
    """M22. The dry run of a batch: skip_attached, reclassified, skip (not active, or no title or date) or
    insert, with the schedule plan and the rule columns a draft would get.

    incoming: seq, title, source_event_id, source_url, start_date, end_date, start_time, end_time, period, tags, price_text, venue, address, area."""
    attached = already_attached(incoming, sources).withColumn("_att", F.lit(True))
    rows = feeddates.schedule_plan(incoming, today).join(attached, "seq", "left").join(decisions.select("seq", "duplicate_status", "matched_id"), "seq", "left")
    plan = F.col("plan")
    last = F.coalesce(F.array_max(F.transform(plan.occurrences, lambda o: o.end_date)), plan.end_date)
    usable = F.coalesce(strip(F.col("title")) != "", F.lit(False)) & F.col("start_date").isNotNull() & F.coalesce(last >= today, F.lit(False))
    action = F.when(F.col("_att"), "skip_attached").when(F.col("duplicate_status") != "none", "reclassified").when(~usable, "skip").otherwise("insert")
    rows = rows.withColumns({"action": action, "_np": classify.price_compact(F.col("price_text")), "_nt": nfkc(F.concat_ws("\n", "title", "venue"))})
    return rows.withColumns({"price_type": classify.price_type(F.col("_np")), "is_night": classify.is_night(F.col("_nt"), F.col("start_time")),
                             "is_kids": classify.kids_from_tags(F.col("tags"), F.col("title")), "category": classify.map_categories(F.col("tags"))}).drop("_att", "_np", "_nt")
