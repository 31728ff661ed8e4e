"""Reviews: what an item competes for, bulk decisions, matching again, and item states as folds."""

from __future__ import annotations

from lodestack.operators import matching, preference
from lodestack.operators.runs import UNDECIDED
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a decision makes of an item's status; accepted and rejected are final.
DECISIONS = {"accept": "accepted", "reject": "rejected", "defer": "deferred"}


def best_of_own(items: DataFrame, releases: DataFrame, policy: tuple[int, int] = (matching.HIGH, matching.MEDIUM)) -> DataFrame:
    """items: candidate_id, the candidate's parts and release_ids, the releases that compete for it. The
    best of these alone with its score; no row where several games share the best score."""
    pairs = items.select("candidate_id", *[F.col(p).alias(f"x_{p}") for p in matching.PARTS], F.explode("release_ids").alias("id")).join(releases, "id")
    sides = pairs.select("candidate_id", "id", "game_id", *[matching.clean(f"x_{p}", p).alias(f"c_{p}") for p in matching.PARTS], *[matching.clean(p, p).alias(f"r_{p}") for p in matching.PARTS])
    sides = matching.with_regions(matching.with_regions(sides, "c"), "r")
    rows = matching.judged(sides, matching.PARTS, least=0)
    rep = F.struct(matching.rank(F.lit(False), F.col("r_region"), F.col("r_edition"), F.col("id")).alias("rep"), "conflict")
    ties = rows.groupBy("candidate_id", "score").agg(F.min(rep).alias("rep"), (F.min("game_id") == F.max("game_id")).alias("one"))
    top = ties.groupBy("candidate_id").agg(F.max("score").alias("score"), F.max_by(F.struct("rep", "one"), "score").alias("t")).where("t.one")
    high, medium = policy
    band = F.when(F.col("score") < medium, "low").when(F.col("t.rep.conflict"), "medium").when(F.col("score") >= high, "high").otherwise("medium")
    return top.select("candidate_id", F.expr("t.rep.rep.i").alias("release_id"), "score", band.alias("confidence"))


def decision_outcomes(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """items: item_id, status, seen (a version of what its decider sees) and, where accepting has to name
    one, candidates. decisions: item_id, decision, seen, seq (their order) and release_id with candidates.
    Adds outcome: not_found; changed, when the item isn't as its decider saw it; final, when it is or was
    meanwhile accepted or rejected; not_competing; else applied, and `made`, the status it gives. Deferring
    leaves an item to later decisions."""
    named = "candidates" in items.columns
    own = items.select("item_id", F.col("status").alias("was"), F.col("seen").alias("now"), *(["candidates"] if named else []))
    rows = decisions.join(own, "item_id", "left")
    competing = F.coalesce(F.array_contains("candidates", F.col("release_id")), F.lit(False)) if named else F.lit(True)
    fit = F.col("was").isin(*UNDECIDED) & (F.col("seen") == F.col("now")) & ((F.col("decision") != "accept") | competing)
    closing = rows.where(fit & (F.col("decision") != "defer")).groupBy("item_id").agg(F.min("seq").alias("closed"))
    outcome = F.when(F.col("was").isNull(), "not_found").when(F.col("seen") != F.col("now"), "changed")
    outcome = outcome.when(~F.col("was").isin(*UNDECIDED) | (F.col("seq") > F.col("closed")), "final").when((F.col("decision") == "accept") & ~competing, "not_competing").otherwise("applied")
    made = F.coalesce(*[F.when(F.col("decision") == d, s) for d, s in DECISIONS.items()])
    return rows.join(closing, "item_id", "left").withColumn("outcome", outcome).select(*decisions.columns, "outcome", F.when(F.col("outcome") == "applied", made).alias("made"))


def decided(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each item once, with its status after all decisions in their order, and outcome: applied if one
    was, else that of the first decision, or none."""
    each = decision_outcomes(items, decisions).groupBy("item_id")
    told = each.agg(F.max_by("made", F.when(F.col("made").isNotNull(), F.col("seq"))).alias("made"), F.min_by("outcome", "seq").alias("first"))
    outcome = F.when(F.col("made").isNotNull(), "applied").otherwise(F.coalesce("first", F.lit("none")))
    return items.join(told, "item_id", "left").select("item_id", F.coalesce("made", "status").alias("status"), "seen", outcome.alias("outcome"))


def decision_summary(items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """How many of `items` these decisions decided, and how many are left undecided."""
    open_item = F.col("status").isin(*UNDECIDED)
    return items.select("item_id").join(outcomes, "item_id").agg(F.count(F.when(F.col("outcome") == "applied", 1)).alias("decided"), F.count(F.when(open_item, 1)).alias("left"))


def requeued(work: DataFrame, items: DataFrame) -> DataFrame:
    """Parked work whose item was accepted goes back to its queue unless its run is cancelled, which
    reopens completed runs; that of rejected ones is done and dismissed in every run; work: run_id,
    status, work_id, state, item_id."""
    rows = work.join(items.select("item_id", F.col("status").alias("review")), "item_id", "left")
    parked = F.col("state") == "parked"
    state = F.when(parked & (F.col("review") == "accepted") & (F.col("status") != "cancelled"), "queued").when(parked & (F.col("review") == "rejected"), "done").otherwise(F.col("state"))
    out = rows.withColumn("new_state", state)
    reopened = out.groupBy("run_id").agg(F.bool_or((F.col("new_state") == "queued") & parked).alias("reopened"))
    status = F.when((F.col("status") == "completed") & F.col("reopened"), "running").otherwise(F.col("status"))
    return out.join(reopened, "run_id").select("run_id", status.alias("status"), "work_id", F.col("new_state").alias("state"), "item_id", ((F.col("new_state") == "done") & parked).alias("dismissed"))


def rematched(items: DataFrame, releases: DataFrame) -> DataFrame:
    """Undecided items whose own releases now give a match of high confidence: their work is queued again."""
    return best_of_own(items.where(F.col("status").isin(*UNDECIDED)), releases).where("confidence = 'high'").select("candidate_id", "release_id")


def settled(work: DataFrame) -> DataFrame:
    """Work with shortfalls or an outranking asset is done; which of the two, shortfalls first."""
    why = F.when(F.col("shortfalls") > 0, "below_quality").when(F.col("outranked_by").isNotNull(), "outranked")
    return work.withColumn("settled", why).withColumn("state", F.when(why.isNotNull() & (F.col("state") == "queued"), "done").otherwise(F.col("state")))


def candidate_outcomes(newcomers: DataFrame, retained: DataFrame, items: DataFrame, kept: int) -> DataFrame:
    """What becomes of originals of high confidence: human_decision_conflict where the candidate was rejected
    or accepted for another release; outranked where `kept` retained assets of its release and type rank
    above it (then with the one that does); else linked. All are judged by what is retained before.
    newcomers: identity, release_id and an asset's columns. items: identity, status, accepted_id. Adds review,
    the item's status after: without a conflict an undecided or superseded one is auto_resolved."""
    slot, order = preference.SLOT, preference.ORDER
    above = preference.outranked(retained, newcomers, kept).withColumnsRenamed({f"new_{c}": c for c in order})
    rows = newcomers.select("identity", *slot, *order).join(above, [*slot, *order], "left").join(items, "identity", "left")
    conflict = F.coalesce((F.col("status") == "rejected") | ((F.col("status") == "accepted") & (F.col("accepted_id") != F.col("release_id"))), F.lit(False))
    outcome = F.when(conflict, "human_decision_conflict").when(F.col("outranker").isNotNull(), "outranked").otherwise("linked")
    closes = F.col("status").isin(*UNDECIDED, "superseded")
    return rows.select("identity", *slot, *order, outcome.alias("outcome"), F.when(~conflict, F.col("outranker")).alias("outranker"), F.when(closes, "auto_resolved").otherwise(F.col("status")).alias("review"))


RUN_MOVES = [("running", "paused"), ("paused", "running"), ("running", "cancelled"), ("paused", "cancelled"), ("running", "completed")]


def run_move(status: Column, target: Column, queued: Column) -> Column:
    """unchanged, applied, has_queued_work or refused: what becomes of a run's move to a target status."""
    allowed = F.lit(False)
    for a, b in RUN_MOVES:
        allowed |= (status == a) & (target == b)
    return F.when(status == target, "unchanged").when((target == "completed") & (queued > 0), "has_queued_work").when(allowed, "applied").otherwise("refused")
