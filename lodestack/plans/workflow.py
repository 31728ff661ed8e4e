"""Queries of search, reviews, reference import and catalog changes, registered with the others."""

from __future__ import annotations

from lodestack.functions import text
from lodestack.operators import coverage, matching, reference, reviews, search, snapshots, summaries
from lodestack.operators.ranks import ranked
from lodestack.plans.registry import _COVERED, _PAIRS, _SUMMARY, _query
from pyspark.sql import functions as F

_STATUS = """, done AS (SELECT id, max(position) FILTER (WHERE missing = 0) AS last FROM per GROUP BY id),
    st AS (SELECT rel.id, CASE WHEN family IS NOT NULL THEN coalesce(last, -1) END AS last FROM rel LEFT JOIN done ON done.id = rel.id)"""
_TITLES = """, claims AS (SELECT *, CASE WHEN k2 % 2 = 0 THEN 'alt' ELSE '' END AS q FROM assertions),
    lc AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY release_id, q, source_id ORDER BY k1 DESC, k2 DESC, k3 DESC) AS rn FROM claims) WHERE rn = 1),
    vt AS (SELECT release_id, q, lower(regexp_replace(value, '\\s', '', 'g')) AS key, count(*) AS n, min((k1, k2, k3, source_id)) AS seen, arg_min(value, (k1, k2, k3, source_id)) AS value
      FROM lc GROUP BY ALL),
    ct AS (SELECT release_id, trim(value) AS value FROM (SELECT *, row_number() OVER (PARTITION BY release_id, q ORDER BY n DESC, seen) AS rn FROM vt) WHERE rn = 1)"""


def _qualified(assertions):
    return assertions.withColumn("qualifier", F.when(F.col("k2") % 2 == 0, "alt").otherwise(""))


@_query("assertions", sql=_TITLES + " SELECT release_id, string_agg(value, '|' ORDER BY value) AS titles FROM ct GROUP BY release_id")
def canonical_titles(assertions):
    return search.canonical_titles(_qualified(assertions)).select("release_id", F.array_join("titles", "|").alias("titles"))


@_query("assertions", sql=" SELECT release_id, string_agg(value, '|' ORDER BY k1, k2, k3, source_id, value) AS claims FROM assertions GROUP BY release_id")
def titles_per_release(assertions):
    return search.titles(assertions).select("release_id", F.array_join("claims", "|").alias("claims"))


_FACETS = _COVERED + _SUMMARY + _STATUS + _TITLES


@_query(
    "release_editions",
    "assets",
    "assertions",
    "work",
    sql=_FACETS
    + """ SELECT s.id, s.title FROM summary s JOIN st ON st.id = s.id WHERE s.id <= 1500
    AND (contains(lower(s.title), 're 2') OR EXISTS (SELECT 1 FROM ct WHERE ct.release_id = s.id AND contains(lower(ct.value), 're 2')))
    AND list_has_any(sources, ['src1', 'src2']) AND list_has_any(asset_types, ['box_front', 'box_back', 'spine', 'box_3d_render', 'map'])
    AND (st.last >= 0 OR s.id IN (SELECT run_id FROM work WHERE review_status = 'pending'))""",
)
def search_facets(releases, assets, assertions, work):
    reviewed = work.where("review_status = 'pending'").select(F.col("run_id").alias("release_id"))
    rows = search.described(releases, assets, _qualified(assertions), coverage.status(releases, assets), reviewed)
    keep = search.facets(sources=["src1", "src2"], asset_types=["packaging", "map"], statuses=["complete", "needs_review"], text=" Re 2 ")
    return rows.where(keep & (F.col("id") <= 1500)).select("id", "title")


_OWN = """, items AS (SELECT candidate_id, title, platform, region, edition, candidate_id % 50 + 1 AS a, candidate_id % 90 + 2 AS b FROM candidates WHERE candidate_id % 3 = 0),
    own AS (SELECT candidate_id, s.release_id, s.game_id, score, e2, e3, e4, rr, re FROM items i
      JOIN scored s ON i.title = ct AND i.platform = cp AND i.region = cr AND i.edition = ce AND (s.release_id = a OR s.release_id = b)),
    t AS (SELECT *, max(score) OVER (PARTITION BY candidate_id) AS best FROM own), u AS (SELECT *, min(game_id) OVER w = max(game_id) OVER w AS one
      FROM t WHERE score = best WINDOW w AS (PARTITION BY candidate_id)),
    pick AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY CASE WHEN lower(re) = 'standard' THEN 0 ELSE 1 END,
      CASE rr WHEN 'world' THEN 0 WHEN 'usa' THEN 1 WHEN 'europe' THEN 2 WHEN 'japan' THEN 3 ELSE 4 END, rr, release_id) AS rn FROM u WHERE one),
    answer AS (SELECT candidate_id, release_id, score,
      CASE WHEN score < 50 THEN 'low' WHEN least(e2, e3, e4) < 0 THEN 'medium' WHEN score >= 80 THEN 'high' ELSE 'medium' END AS confidence FROM pick
      WHERE rn = 1)"""


def _items(candidates):
    ids = F.array_distinct(F.array(F.col("candidate_id") % 50 + 1, F.col("candidate_id") % 90 + 2))
    return candidates.where("candidate_id % 3 = 0").withColumns({"release_ids": ids, "status": F.when(F.col("candidate_id") % 2 == 0, "pending").otherwise("accepted")})


@_query("candidates", "release_editions", sql=_PAIRS + _OWN + " SELECT * FROM answer")
def best_of_own_list(candidates, releases):
    return reviews.best_of_own(_items(candidates), releases)


@_query("candidates", "release_editions", sql=_PAIRS + _OWN + " SELECT candidate_id, release_id FROM answer WHERE confidence = 'high' AND candidate_id % 2 = 0")
def rematched_reviews(candidates, releases):
    return reviews.rematched(_items(candidates), releases)


_DECIDED = """, it AS (SELECT work_id AS item_id, review_status AS status, work_id % 3 AS seen FROM work),
    de AS (SELECT work_id AS item_id, CASE work_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'reject' ELSE 'defer' END AS decision, work_id % 2 AS saw, 1 AS turn FROM work WHERE work_id % 5 <> 0
      UNION ALL SELECT work_id, CASE WHEN work_id % 2 = 0 THEN 'reject' ELSE 'accept' END, work_id % 3, 2 FROM work WHERE work_id % 7 < 2),
    j AS (SELECT de.*, status, saw = seen AS fresh, status IN ('pending', 'deferred') AS free FROM de JOIN it USING (item_id)),
    f AS (SELECT item_id, min(turn) AS closed FROM j WHERE fresh AND free AND decision <> 'defer' GROUP BY item_id),
    o AS (SELECT j.*, CASE WHEN NOT fresh THEN 'changed' WHEN NOT free OR turn > closed THEN 'final' ELSE 'applied' END AS outcome FROM j LEFT JOIN f USING (item_id)),
    now AS (SELECT it.item_id, coalesce(arg_max(CASE decision WHEN 'accept' THEN 'accepted' WHEN 'reject' THEN 'rejected'
      ELSE 'deferred' END, turn) FILTER (WHERE outcome = 'applied'), any_value(it.status)) AS status, any_value(it.seen) AS seen,
      CASE WHEN count(*) FILTER (WHERE outcome = 'applied') > 0 THEN 'applied' ELSE coalesce(arg_min(outcome, turn), 'none') END AS outcome FROM it LEFT JOIN o USING (item_id) GROUP BY it.item_id)"""


def _decided(work):
    items = work.select(F.col("work_id").alias("item_id"), F.col("review_status").alias("status"), (F.col("work_id") % 3).alias("seen"))
    decision = F.when(F.col("work_id") % 4 == 0, "accept").when(F.col("work_id") % 4 == 1, "reject").otherwise("defer")
    first = work.where("work_id % 5 <> 0").select(F.col("work_id").alias("item_id"), decision.alias("decision"), (F.col("work_id") % 2).alias("seen"), F.lit(1).alias("seq"))
    later = F.when(F.col("work_id") % 2 == 0, "reject").otherwise("accept")
    second = work.where("work_id % 7 < 2").select(F.col("work_id").alias("item_id"), later.alias("decision"), (F.col("work_id") % 3).alias("seen"), F.lit(2).alias("seq"))
    return reviews.decided(items, first.unionByName(second))


@_query("work", sql=_DECIDED + " SELECT * FROM now")
def bulk_decisions(work):
    return _decided(work)


@_query("work", sql=_DECIDED + " SELECT count(*) FILTER (WHERE outcome = 'applied') AS decided, count(*) FILTER (WHERE status IN ('pending', 'deferred')) AS \"left\" FROM now WHERE item_id % 5 <> 0")
def decision_summary(work):
    return reviews.decision_summary(work.where("work_id % 5 <> 0").select(F.col("work_id").alias("item_id")), _decided(work))


@_query(
    "runs",
    "work",
    sql=""", w AS (SELECT w.run_id, r.status, work_id, state, review_status AS review,
      CASE WHEN state = 'parked' AND review_status = 'rejected' THEN 'done' WHEN state = 'parked' AND review_status = 'accepted' AND r.status <> 'cancelled' THEN 'queued' ELSE state END AS now FROM work w JOIN runs r ON r.run_id = w.run_id)
    SELECT run_id, CASE WHEN status = 'completed' AND bool_or(now = 'queued' AND state = 'parked') OVER (PARTITION BY run_id) THEN 'running'
      ELSE status END AS status, work_id, now AS state, work_id AS item_id, now = 'done' AND state = 'parked' AS dismissed FROM w""",
)
def requeued_work(all_runs, work):
    rows = work.join(all_runs, "run_id").select("run_id", "status", "work_id", "state", F.col("work_id").alias("item_id"))
    return reviews.requeued(rows, work.select(F.col("work_id").alias("item_id"), F.col("review_status").alias("status")))


@_query("runs", "work", sql=""", q AS (SELECT r.run_id, r.status, count(*) FILTER (WHERE state = 'queued') AS queued FROM runs r LEFT
      JOIN work w ON w.run_id = r.run_id GROUP BY ALL), t(target) AS (VALUES ('running'), ('paused'), ('cancelled'), ('completed'))
    SELECT run_id, target, CASE WHEN status = target THEN 'unchanged' WHEN target = 'completed' AND queued > 0 THEN 'has_queued_work' WHEN (status, target) IN (('running', 'paused'), ('paused', 'running'), ('running', 'cancelled'), ('paused', 'cancelled'), ('running', 'completed')) THEN 'applied'
      ELSE 'refused' END AS outcome FROM q, t""")
def run_moves(all_runs, work):
    queued = work.where("state = 'queued'").groupBy("run_id").agg(F.count("*").alias("queued"))
    rows = all_runs.join(queued, "run_id", "left").withColumn("target", F.explode(F.array(*[F.lit(t) for t in ("running", "paused", "cancelled", "completed")])))
    return rows.select("run_id", "target", reviews.run_move(F.col("status"), F.col("target"), F.coalesce("queued", F.lit(0))).alias("outcome"))


_GAMES = """, rec AS (SELECT id AS record_id, 'src' || cast(id % 3 AS VARCHAR) AS own, lower(title) AS t, lower(platform) AS p, lower(region) AS r, lower(edition) AS e
      FROM release_editions WHERE id % 4 = 0),
    ed AS (SELECT id, game_id, lower(title) AS t, lower(platform) AS p, lower(region) AS r, lower(edition) AS e, 'src' || cast(id % 4 AS VARCHAR) AS s FROM release_editions WHERE id % 4 <> 0),
    f AS (SELECT record_id, game_id, row_number() OVER (PARTITION BY record_id ORDER BY CASE WHEN s = own THEN 0 ELSE 1 END, id) AS rn FROM rec JOIN ed USING (t, p)
      WHERE NOT EXISTS (SELECT 1 FROM ed x WHERE x.game_id = ed.game_id AND x.p = rec.p AND x.r = rec.r AND x.e = rec.e AND x.s <> rec.own))
    SELECT record_id, game_id FROM rec LEFT JOIN (SELECT * FROM f WHERE rn = 1) USING (record_id)"""


@_query("release_editions", sql=_GAMES)
def game_for_new_edition(releases):
    records = releases.where("id % 4 = 0").select(F.col("id").alias("record_id"), F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source_id"), "title", "platform", "region", "edition")
    known = releases.where("id % 4 <> 0")
    claims = known.select(F.col("id").alias("release_id"), F.concat(F.lit("src"), (F.col("id") % 4).cast("string")).alias("source_id"), "title")
    return reference.games_for_new_editions(records, known, claims, claims.select("release_id", "source_id"))


@_query("release_editions", sql=""" SELECT c.id AS changed_id, 'src' || cast(p.id % 3 AS VARCHAR) AS source_id, p.id AS record_id, p.id AS release_id FROM release_editions c JOIN release_editions p
    ON p.id % 7 = c.id % 7 AND p.id % 3 <> c.id % 3 AND lower(p.platform) = lower(c.platform) AND lower(p.region) = lower(c.region) AND lower(p.edition) = lower(c.edition) WHERE c.id % 5 = 0""")
def dump_peers(releases):
    source, dump = F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source_id"), (F.col("id") % 7).cast("string").alias("dump_set")
    sets = releases.select(source, F.col("id").alias("record_id"), F.col("id").alias("release_id"), dump)
    return reference.dump_peers(releases.where("id % 5 = 0").select(source, F.col("id").alias("release_id"), dump), sets, releases)


@_query("release_editions", "assets", sql=""", h AS (SELECT DISTINCT release_id, source_id, game_id FROM assets JOIN release_editions r ON r.id = release_id) SELECT DISTINCT a.release_id AS a, b.release_id AS b FROM h a
      JOIN h b ON a.game_id = b.game_id AND a.source_id = b.source_id AND a.release_id < b.release_id""")
def editions_sharing_a_source(releases, assets):
    return reference.sharing_a_source(releases, assets.select("release_id", "source_id"))


@_query("release_editions", sql=" SELECT id, NOT starts_with(title, '[BIOS]') AND id % 12 NOT IN (3, 10, 11) AS retail FROM release_editions")
def retail_filter(releases):
    tags = ["USA", "Atlantis", "Rev 1", "Beta 2", "En,Fr", "1996", "Disc 1", "v1.2", "Revision B", "rev 2", " betamax", "Proto-1"]
    edition = F.concat(F.col("edition"), F.lit(" · "), F.get(F.array(*[F.lit(t) for t in tags]), (F.col("id") % 12).cast("int")))
    return releases.select("id", summaries.is_retail(F.col("title"), edition).alias("retail"))


@_query("release_editions", sql=""" SELECT coalesce(split_part(platform, ' - ', 1), '') AS maker, string_agg(DISTINCT split_part(platform, ' - ', 2), '|'
      ORDER BY split_part(platform, ' - ', 2)) AS consoles FROM release_editions WHERE contains(platform, ' - ') AND contains(lower(platform), 'o')
      GROUP BY 1""")
def consoles_by_maker(releases):
    return summaries.consoles(releases.where("contains(platform, ' - ')"), " O ").select("maker", F.array_join("consoles", "|").alias("consoles"))


@_query("assets", sql=" SELECT object_hash, string_agg(DISTINCT media_type, ',' ORDER BY media_type) AS media_types FROM assets GROUP BY object_hash")
def originals_by_hash(assets):
    return summaries.originals_by_hash(assets).select("object_hash", F.array_join("media_types", ",").alias("media_types"))


@_query("assets", sql=""" SELECT release_id, max(object_hash) FILTER (WHERE asset_type = 'box_front') AS front, max(object_hash) FILTER (WHERE asset_type = 'box_back') AS back, max(object_hash) FILTER (WHERE asset_type = 'spine') AS spine
      FROM assets GROUP BY release_id HAVING count(*) FILTER (WHERE asset_type = 'box_front') > 0""")
def packaging_slots(assets):
    return summaries.packaging_slots(assets.select("release_id", "asset_type", "object_hash"))


@_query("assets", sql=""", c AS (SELECT release_id, source_id, media_type AS location, asset_type AS field, object_hash AS value, row_number() OVER (ORDER BY k1, k2, k3, release_id) AS seq, k1 % 10 = 0 AS again
      FROM assets)
    SELECT release_id, source_id, location, field, '' AS qualifier, value, max(CASE WHEN again THEN seq + (SELECT max(seq) FROM c WHERE NOT again) + 1 ELSE seq END) AS seq FROM c GROUP BY ALL""")
def observed_claims(assets):
    own = assets.select("release_id", "source_id", "media_type", "asset_type", "object_hash", "k1", "k2", "k3", F.lit(0).alias("all"))
    rows = ranked(own, ["all"], ["k1", "k2", "k3", "release_id"], "seq").withColumn("again", F.col("k1") % 10 == 0)
    rows = rows.select("release_id", "source_id", F.col("media_type").alias("location"), F.col("asset_type").alias("field"), F.lit("").alias("qualifier"), F.col("object_hash").alias("value"), "seq", "again")
    return snapshots.observed(rows.where("not again").drop("again"), rows.where("again").drop("again"))


@_query("release_editions", "assets", sql=" SELECT id FROM release_editions WHERE id % 9 <> 0 OR id % 27 = 0")
def merged_editions(releases, assets):
    merges = releases.where("id % 9 = 0 and id % 27 <> 0").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("into_id"), F.col("id").alias("seq"))
    claims = assets.select("release_id", "source_id", F.lit("l").alias("location"), F.lit("f").alias("field"), F.lit("").alias("qualifier"), F.lit("v").alias("value"), F.col("k1").alias("seq"))
    return snapshots.merged(releases, claims, merges)[0].select("id")


@_query("assets", sql=" SELECT DISTINCT release_id AS game_id FROM assets WHERE release_id % 2 = 0")
def games_without_orphans(assets):
    games = assets.select(F.col("release_id").alias("game_id")).distinct()
    return snapshots.without_orphans(games, assets.where("release_id % 2 = 0").select(F.col("release_id").alias("game_id")))


@_query("assertions", sql=""" SELECT release_id, k1, k2, k3, list_aggregate(list_sort(list_distinct(list_filter(string_split_regex(lower(value), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))), 'string_agg', ' ') AS words
      FROM assertions""")
def platform_words(assertions):
    return assertions.select("release_id", "k1", "k2", "k3", F.array_join(text.word_set(F.col("value")), " ").alias("words"))
