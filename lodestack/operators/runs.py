"""Acquisition runs: counters, progress, fair queue, stale work, failures, reviews."""

from __future__ import annotations

from lodestack.operators.ranks import ranked
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

UNDECIDED = ["pending", "deferred"]


def counters(runs: DataFrame, work: DataFrame) -> DataFrame:
    """Filtered counts per run in one aggregate, runs without work included; those of work below the quality
    asked for, and outranked by what is there, where `work` has these columns (shortfalls, outranked_by)."""
    count = lambda cond: F.count(F.when(cond, 1))
    s, open_review = F.col("state"), F.col("review_status").isin(*UNDECIDED)
    per = work.groupBy("run_id").agg(
        count(s == "queued").alias("queued"), count(s == "parked").alias("parked"), count(s == "done").alias("done"),
        count((s == "parked") & open_review).alias("needs_review"), count(F.col("unavailable")).alias("unavailable"),
        *[count(F.col(c).isNotNull()).alias(n) for c, n in (("shortfalls", "below_quality"), ("outranked_by", "outranked")) if c in work.columns],
        count(F.col("skipped")).alias("skipped"), count((s == "done") & (F.col("review_status") == "rejected")).alias("dismissed"),
    )
    names = [c for c in per.columns if c != "run_id"]
    return runs.join(per, "run_id", "left").select("run_id", "status", *[F.coalesce(c, F.lit(0)).alias(c) for c in names])


def progress(runs: DataFrame, work: DataFrame) -> DataFrame:
    """Acquired items, the mean over sources of the share that is done, and the share of all."""
    share = work.groupBy("run_id", "source_id").agg((F.count(F.when(F.col("state") == "done", 1)) / F.count("*")).alias("share"))
    mean = share.groupBy("run_id").agg(F.avg("share").alias("mean_share"))
    c = counters(runs, work)
    total = F.col("queued") + F.col("parked") + F.col("done")
    acquired = F.greatest(F.col("done") - F.col("unavailable") - F.col("skipped") - F.col("dismissed"), F.lit(0))
    return c.join(mean, "run_id", "left").select("run_id", acquired.alias("acquired"), F.coalesce("mean_share", F.lit(0.0)).alias("mean_share"), F.when(total > 0, F.col("done") / total).otherwise(0.0).alias("done_share"))


def fair_queue(runs: DataFrame, work: DataFrame, n: int, skip: list[str] = ()) -> DataFrame:
    """The oldest n queued items of each source of each running run, with their turn."""
    queued = work.where(F.col("state") == "queued")
    if skip:
        queued = queued.where(~F.col("source_id").isin(*skip))
    queued = queued.join(runs.where("status = 'running'").select("run_id"), "run_id", "left_semi")
    turn = F.row_number().over(Window.partitionBy("run_id", "source_id").orderBy("work_id"))
    return queued.withColumn("turn", turn).where(F.col("turn") <= n).select("run_id", "turn", "work_id", "source_id")


def stale(runs: DataFrame, work: DataFrame) -> DataFrame:
    """Unfinished work that nobody will finish, with the reason."""
    why = F.when(F.col("status") == "cancelled", F.lit(None)).when((F.col("status") == "completed") & (F.col("state") == "queued"), "completed_run")
    why = why.when((F.col("state") == "parked") & ~F.col("review_status").isin(*UNDECIDED), "closed_review")
    return work.where("state <> 'done'").join(runs, "run_id").withColumn("reason", why).where("reason is not null").select("run_id", "work_id", "reason")


def undecided_page(work: DataFrame, size: int, offset: int) -> DataFrame:
    """One page of undecided reviews by id, each row with the count of all (a scalar subquery, not a
    window, so that no task holds them all)."""
    found = work.where(F.col("review_status").isin(*UNDECIDED))
    total = found.agg(F.count("*").alias("total"))
    rows = found.orderBy("work_id").offset(offset).limit(size)
    return rows.join(F.broadcast(total)).select("work_id", "review_status", "total")  # one row


def failures(log: DataFrame, latest: int = 3) -> DataFrame:
    """The latest failures of each source with the count of all of them."""
    counts = log.groupBy("source_id").agg(F.count("*").alias("failures"))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("sequence")))
    last = log.withColumn("rank", rank).where(F.col("rank") <= latest)
    stage = F.when(F.get_json_object("props", "$.k").cast("int") % 2 == 0, "discovery").otherwise("download")
    return last.join(counts, "source_id").select("source_id", "rank", "sequence", stage.alias("stage"), "failures")


def undecided_candidates(candidates: DataFrame, work: DataFrame) -> DataFrame:
    """Candidates whose review is undecided."""
    open_items = work.where(F.col("review_status").isin(*UNDECIDED)).select(F.col("work_id").alias("candidate_id"))
    return candidates.join(open_items.hint("merge"), "candidate_id", "left_semi")  # ids grow with the work: not by way of the driver


def dedupe(work: DataFrame, key: list[str]) -> DataFrame:
    """The first item of each key; later ones change nothing (idempotent enqueue)."""
    first = work.groupBy(*key).agg(F.min("work_id").alias("work_id"), F.count("*").alias("offered"))
    return first


#: Downloads ahead of a source's work, for each that it may have at once.
READ_AHEAD = 4


def prefetch(queue: DataFrame, per_source: int, failed: list[str] = ()) -> DataFrame:
    """The downloads to begin, in their order: of the oldest per_source * READ_AHEAD queued items of each
    source the first per_source that would be imported, but for those begun before; every source's next one
    comes before any source's further one. queue: source_id, work_id, enabled, importable, begun. Adds
    turn (how many downloads of the source come before) and place."""
    oldest = ranked(queue.where(~F.col("source_id").isin(*failed)) if failed else queue, ["source_id"], ["work_id"], "_age")
    able = oldest.where((F.col("_age") <= per_source * READ_AHEAD) & F.col("enabled") & (F.col("importable") | F.col("begun")))
    turn = F.row_number().over(Window.partitionBy("source_id").orderBy("work_id")) - 1  # per_source * READ_AHEAD rows at most
    new = able.withColumn("turn", turn).where((F.col("turn") < per_source) & ~F.col("begun")).select("source_id", "work_id", "turn")
    return ranked(new.withColumn("_all", F.lit(0)), ["_all"], ["turn", "work_id"], "place").drop("_all")


def known_sources(discoveries: DataFrame, batches: DataFrame) -> DataFrame:
    """Sources whose discovery for a run is done or goes on in batches: they may have queued work."""
    return discoveries.select("run_id", "source_id").unionByName(batches.select("run_id", "source_id")).distinct()


def all_discovered(planned: DataFrame, complete: DataFrame) -> DataFrame:
    """Whether every planned source of a run has been asked for all games; planned: run_id, source_id."""
    done = complete.select("run_id", "source_id").distinct().withColumn("done", F.lit(True))
    rows = planned.select("run_id", "source_id").distinct().join(done, ["run_id", "source_id"], "left")
    return rows.groupBy("run_id").agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_discovered"))


def moved_runs(runs: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves of runs in their order, each made only on the version that its asker saw: compare and set. runs:
    run_id, status, version, queued. moves: run_id, target, version, seq. One row per move with its outcome:
    not_found, changed (another version is there), unchanged, has_queued_work, refused or applied, which
    makes the next version. A run's moves are folded in one row, as each depends on those before."""
    from lodestack.operators.reviews import run_move

    own = moves.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("seq", "target", "version"))).alias("moves"))
    rows = own.join(runs, "run_id", "left")
    done = "struct<status:string,version:bigint,outcomes:array<struct<seq:bigint,target:string,outcome:string,status:string,version:bigint>>>"
    start = F.struct(F.col("status"), F.col("version"), F.array()).cast(done)

    def step(at: Column, m: Column) -> Column:
        outcome = F.when(at["status"].isNull(), "not_found").when(at["version"] != m["version"], "changed").otherwise(run_move(at["status"], m["target"], F.col("queued")))
        applied = outcome == "applied"
        status, version = F.when(applied, m["target"]).otherwise(at["status"]), at["version"] + applied.cast("long")
        return F.struct(status, version, F.concat(at["outcomes"], F.array(F.struct(m["seq"].alias("seq"), m["target"].alias("target"), outcome.alias("outcome"), status.alias("status"), version.cast("long").alias("version"))))).cast(done)

    told = F.aggregate(F.transform("moves", lambda m: m.withField("seq", m["seq"].cast("long"))), start, step)["outcomes"]
    return rows.select("run_id", F.explode(told).alias("o")).select("run_id", "o.*")
