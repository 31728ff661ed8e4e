"""Queries of lookups, summaries and order, registered with the others."""

from __future__ import annotations

from lodestack.functions import dims
from lodestack.operators import matching, reference, reviews, runs, search, snapshots, summaries
from lodestack.plans.registry import _PAIRS, BEST, _query
from pyspark.sql import functions as F


def _n(c: str, n: int, prefix: str = "src"):
    return F.concat(F.lit(prefix), (F.col(c) % n).cast("string"))


@_query(
    "candidates",
    "release_editions",
    sql=_PAIRS
    + " SELECT candidate_id, string_agg(release_id || ':' || score || ':' || e1 || '/' || e2 || '/' || e3 || '/' || e4, '|' ORDER BY score DESC, release_id) AS matches"
    + " FROM candidates c JOIN scored ON c.title = ct AND c.platform = cp AND c.region = cr AND c.edition = ce WHERE score >= 50 GROUP BY candidate_id",
)
def competing_lists(candidates, releases):
    points = lambda m: F.concat_ws("/", *[m[f"e_{p}"].cast("string") for p in matching.PARTS])
    one = lambda m: F.concat_ws(":", m["release_id"].cast("string"), m["score"].cast("string"), points(m))
    return matching.competing_lists(candidates, releases, told=lambda matches: F.array_join(F.transform(matches, one), "|"))


@_query(
    "release_editions",
    "assets",
    sql=""", c AS (SELECT 'src' || (k3 % 3) AS source_id, (k1 % 500)::VARCHAR AS record, min(release_id) AS release_id FROM assets WHERE k2 = 1 GROUP BY ALL)
    SELECT id AS record_id, release_id FROM release_editions JOIN c ON c.source_id = 'src' || (id % 3) AND record = id::VARCHAR""",
)
def known_editions(releases, assets):
    records = releases.select(F.col("id").alias("record_id"), _n("id", 3).alias("source_id"), F.col("id").cast("string").alias("source_record"))
    field = F.when(F.col("k2") == 1, "identifier").otherwise("title")
    claims = assets.select("release_id", _n("k3", 3).alias("source_id"), field.alias("field"), F.lit("source_record").alias("qualifier"), (F.col("k1") % 500).cast("string").alias("value"))
    return reference.known_editions(records, claims)


@_query(
    "assets",
    sql=""", p AS (SELECT DISTINCT release_id, asset_type, object_hash, 'i' || (k1 % 60) AS identity, k1 % 60 AS i FROM assets)
    SELECT DISTINCT release_id, asset_type, object_hash FROM p WHERE i % 4 <> 0 OR (i % 8 = 0 AND release_id = i + 1)""",
)
def detached_assets(assets):
    i = F.col("k1") % 60
    rows = assets.withColumns({"i": i, "identity": _n("k1", 60, "i")})
    provenance = rows.select("release_id", "asset_type", "object_hash", "identity").distinct()
    links = rows.where("i % 4 = 0").select("identity").distinct()
    keep = rows.where("i % 8 = 0").select("identity", (F.col("i") + 1).alias("kept_id")).distinct()
    return snapshots.detached(provenance, assets.select("release_id", "asset_type", "object_hash").distinct(), links, keep)[1]


@_query(
    "release_editions",
    "assertions",
    sql=""", t AS (SELECT release_id, source_id, arg_max(value, (k1, k2, k3, value)) AS value FROM assertions GROUP BY ALL),
    n AS (SELECT release_id, string_agg(source_id || '=' || value, '|' ORDER BY source_id) AS titles FROM t GROUP BY release_id),
    i AS (SELECT id AS item_id, unnest([0, 1, 2]) AS pos, unnest([id, id + 1, id + 1000000]) AS id FROM release_editions)
    SELECT item_id, pos, i.id, title, coalesce(titles, '') AS titles FROM i JOIN release_editions r ON r.id = i.id LEFT JOIN n ON n.release_id = i.id""",
)
def described_review_items(releases, assertions):
    items = releases.select(F.col("id").alias("item_id"), F.col("id").alias("release_id"), F.array(F.col("id") + 1, F.col("id") + 1_000_000).alias("candidates"))
    told = F.array_join(F.transform("titles", lambda t: F.concat(t["source_id"], F.lit("="), t["value"])), "|")
    return reference.described_items(items, releases, assertions).select("item_id", "pos", "id", "title", F.coalesce(told, F.lit("")).alias("titles"))


@_query(
    "assets",
    sql=""", old AS (SELECT object_hash, asset_type AS recipe, min('o' || k1) AS output FROM assets WHERE k1 % 3 = 0
      GROUP BY ALL), new AS (SELECT object_hash, asset_type AS recipe, min('n' || k1) AS output FROM assets WHERE k1 % 3 = 1 GROUP BY ALL)
    SELECT object_hash, recipe, coalesce(old.output, new.output) AS output FROM old FULL JOIN new USING (object_hash, recipe)
      WHERE coalesce(old.output, new.output) NOT IN (SELECT 'o' || k1 FROM assets WHERE k1 % 9 = 0)""",
)
def derivatives_after(assets):
    row = lambda n, p: assets.where(f"k1 % 3 = {n}").groupBy("object_hash", F.col("asset_type").alias("recipe")).agg(F.min(F.concat(F.lit(p), F.col("k1").cast("string"))).alias("output"))
    new = assets.where("k1 % 3 = 1").select("object_hash", F.col("asset_type").alias("recipe"), F.concat(F.lit("n"), F.col("k1").cast("string")).alias("output"))
    gone = assets.where("k1 % 9 = 0").select(F.concat(F.lit("o"), F.col("k1").cast("string")).alias("object_hash")).distinct()
    return snapshots.forgotten(snapshots.recorded(row(0, "o"), new), gone)


@_query(
    "work",
    sql=""" SELECT run_id, work_id, CASE WHEN state = 'queued' AND (work_id % 5 = 0 OR work_id % 3 = 0) THEN 'done' ELSE state END AS state,
    CASE WHEN work_id % 5 = 0 THEN 'below_quality' WHEN work_id % 3 = 0 THEN 'outranked' END AS settled FROM work""",
)
def settled_work(work):
    rows = work.withColumns({"shortfalls": F.when(F.col("work_id") % 5 == 0, 2).otherwise(0), "outranked_by": F.when(F.col("work_id") % 3 == 0, "h")})
    return reviews.settled(rows).select("run_id", "work_id", "state", "settled")


@_query("release_editions", sql=" SELECT arg_min(id, id) AS id, arg_min(title, id) AS title FROM release_editions GROUP BY lower(trim(title)), platform")
def games_first_seen(releases):
    return summaries.first_seen(releases.select("id", "title", "platform"), F.concat(F.lower(F.trim("title")), F.lit("|"), F.col("platform")), "id").select("id", "title")


@_query(
    "runs",
    "work",
    sql=""", p AS (SELECT run_id, unnest(['src1', 'src' || (run_id % 9), 'src8']) AS source_id, unnest([0, 1, 2]) AS pos
      FROM runs), d AS (SELECT DISTINCT run_id, source_id FROM work WHERE state = 'done'), b AS (SELECT run_id, source_id, count(*) AS games FROM work
      GROUP BY ALL)
    SELECT p.run_id, pos, p.source_id, d.run_id IS NOT NULL AS complete, coalesce(games, 0) AS games FROM p LEFT JOIN d USING (run_id, source_id) LEFT JOIN b USING (run_id, source_id)""",
)
def run_discoveries(all_runs, work):
    planned = all_runs.select("run_id", F.array(F.lit("src1"), _n("run_id", 9), F.lit("src8")).alias("sources"))
    return summaries.discoveries(planned, work.where("state = 'done'"), work.groupBy("run_id", "source_id").agg(F.count("*").alias("games")))


@_query("assets", sql=""", d AS (SELECT DISTINCT object_hash, asset_type AS recipe, md5(object_hash || asset_type) AS output
      FROM assets) SELECT object_hash, string_agg(output, '|' ORDER BY recipe, output) AS outputs FROM d GROUP BY object_hash""")
def derived_by_original(assets):
    rows = assets.select("object_hash", F.col("asset_type").alias("recipe"), F.md5(F.concat("object_hash", "asset_type")).alias("output")).distinct()
    return summaries.derived_by_original(rows).select("object_hash", F.array_join("outputs", "|").alias("outputs"))


_SORTED = "(lower(title), lower(platform), lower(region), lower(edition), id)"


@_query(
    "release_editions",
    sql=f""", f AS (SELECT * FROM release_editions WHERE contains(lower(title), 're')), a AS (SELECT {_SORTED} AS k FROM f WHERE id = (SELECT min(id) FROM f))
    SELECT id, title, (SELECT count(*) FROM f) AS total FROM f WHERE {_SORTED} > (SELECT k FROM a) ORDER BY {_SORTED} LIMIT 20""",
)
def search_page_after(releases):
    found = releases.where(F.contains(F.lower("title"), F.lit("re")))
    first = found.agg(F.min("id")).first()[0]
    page, total = search.result_page(found, search.snapshot(releases), 20, first)
    return page.select("id", "title", F.lit(total).cast("long").alias("total"))


@_query(
    "work",
    sql=""", s AS (SELECT DISTINCT source_id FROM work), f AS (SELECT source_id, work_id % 3 = 0 AS optional,
      CASE work_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'unreadable' ELSE 'stored' END AS state FROM work WHERE source_id <> 'src6')
    SELECT s.source_id, s.source_id NOT IN ('src2', 'src4') AS enabled,
      CASE WHEN count(f.state) = 0 THEN 'not_needed' WHEN bool_or(state = 'unreadable') THEN 'unreadable' WHEN bool_or(NOT optional AND state = 'missing') THEN 'missing'
      ELSE 'stored' END AS credential
    FROM s LEFT JOIN f USING (source_id) GROUP BY s.source_id""",
)
def described_sources(work):
    state = F.when(F.col("work_id") % 5 == 0, "missing").when(F.col("work_id") % 5 == 1, "unreadable").otherwise("stored")
    fields = work.where("source_id <> 'src6'").select("source_id", (F.col("work_id") % 3 == 0).alias("optional"), state.alias("state"))
    off = work.where("source_id in ('src2', 'src4')").select("source_id")
    return summaries.described_sources(work.select("source_id").distinct(), fields, off)


@_query(
    "assets",
    sql=""", s AS (SELECT source_id, list_sort(list(DISTINCT asset_type)) AS types, source_id <> 'src1' AS enabled, source_id <> 'src2' AS direct FROM assets WHERE k2 <= 3 GROUP BY source_id)
    SELECT source_id, CASE WHEN enabled AND direct AND list_has_any(types, ['disc', 'map']) THEN array_to_string(list_filter(types, lambda t: t IN ('disc', 'map')), ',') ELSE '' END AS asset_types,
    CASE WHEN NOT enabled THEN 'disabled' WHEN NOT direct THEN 'cannot download media directly' WHEN NOT list_has_any(types, ['disc', 'map']) THEN 'acquires none of the requested asset types' END AS excluded FROM s""",
)
def capable_sources(assets):
    sources = assets.where("k2 <= 3").groupBy("source_id").agg(F.sort_array(F.collect_set("asset_type")).alias("asset_types"))
    sources = sources.withColumns({"enabled": F.col("source_id") != "src1", "direct": F.col("source_id") != "src2"})
    found = summaries.capable(sources, ["disc", "map"])
    return found.select("source_id", F.coalesce(F.array_join("asset_types", ","), F.lit("")).alias("asset_types"), "excluded")


@_query(
    "assets",
    sql=""", r AS (SELECT CASE WHEN k1 % 7 = 0 THEN 'exported' WHEN k1 % 7 < 3 THEN 'there' ELSE 'missing' END AS outcome FROM assets)
    SELECT count(*) FILTER (WHERE outcome = 'exported') AS exported, count(*) FILTER (WHERE outcome = 'there') AS there, count(*) FILTER (WHERE outcome = 'missing') AS missing, 0::BIGINT AS failed
      FROM r""",
)
def export_outcomes(assets):
    outcome = F.when(F.col("k1") % 7 == 0, "exported").when(F.col("k1") % 7 < 3, "there").otherwise("missing")
    return summaries.by_outcome(assets.select(outcome.alias("outcome")), ["exported", "there", "missing", "failed"])


@_query(
    "assets",
    sql=""", s AS (SELECT release_id, k1, k2, k3, width AS w, height AS h, least(1.0::DOUBLE, 256.0::DOUBLE / greatest(width, height)) AS scale FROM assets WHERE width IS NOT NULL)
    SELECT release_id, k1, k2, k3, greatest(1, round(w * scale)::INT) AS tw, greatest(1, round(h * scale)::INT) AS th FROM s""",
)
def thumbnail_sizes(assets):
    w, h = summaries.fit_within(F.col("width"), F.col("height"), 256)
    return assets.where("width is not null").select("release_id", "k1", "k2", "k3", w.alias("tw"), h.alias("th"))


@_query(
    "release_editions",
    sql=""", i AS (SELECT id AS item_id, list_sort(list_distinct([id + 1, id + 2, id + 3])) AS c
      FROM release_editions), m AS (SELECT id AS a, id - 1 AS b, id AS seq FROM release_editions WHERE id % 5 = 0),
    e AS (SELECT item_id, unnest(c) AS x, unnest([0, 1, 2]) AS pos
      FROM i), f AS (SELECT item_id, coalesce(b, x) AS y, min((b IS NOT NULL, coalesce(seq, pos))) AS place FROM e LEFT JOIN m ON a = x GROUP BY ALL)
    SELECT item_id, string_agg(y::VARCHAR, ',' ORDER BY place) AS candidates FROM f GROUP BY item_id""",
)
def candidates_after_merges(releases):
    items = releases.select(F.col("id").alias("item_id"), F.array(*[F.col("id") + k for k in (1, 2, 3)]).alias("candidates"))
    merges = releases.where("id % 5 = 0").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("into_id"), F.col("id").alias("seq"))
    return snapshots.renamed_candidates(items, merges).select("item_id", F.array_join(F.transform("candidates", lambda c: c.cast("string")), ",").alias("candidates"))


@_query(
    "assets",
    sql=f""", ret AS (SELECT *, {BEST} AS px, row_number() OVER (PARTITION BY release_id, asset_type ORDER BY {BEST} DESC, byte_len DESC, k1, k2, k3) AS rn FROM assets WHERE k2 <= 4),
    new AS (SELECT *, {BEST} AS px, 'c' || k1 || '-' || k2 || '-' || k3 || '-' || release_id AS identity FROM assets WHERE k2 > 4),
    o AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM ret x
      WHERE x.release_id = n.release_id AND x.asset_type = n.asset_type AND x.object_hash = n.object_hash) THEN NULL ELSE r.object_hash END AS above
      FROM new n LEFT JOIN ret r ON r.rn = 1 AND r.release_id = n.release_id AND r.asset_type = n.asset_type AND (r.px > n.px OR (r.px = n.px AND r.byte_len >= n.byte_len))),
    s AS (SELECT *, CASE k1 % 7 WHEN 0 THEN 'rejected' WHEN 1 THEN 'accepted' WHEN 2 THEN 'pending' WHEN 3 THEN 'superseded' END AS status, k1 % 7 = 0 OR (k1 % 7 = 1 AND k1 % 2 = 0) AS conflict
      FROM o)
    SELECT identity, release_id, asset_type, k1, k2, k3, CASE WHEN conflict THEN 'human_decision_conflict' WHEN above IS NOT NULL THEN 'outranked'
      ELSE 'linked' END AS outcome, CASE WHEN NOT conflict THEN above END AS outranker,
      CASE WHEN status IN ('pending', 'superseded') THEN 'auto_resolved' ELSE status END AS review FROM s""",
)
def candidate_outcomes(assets):
    identity = F.concat(F.lit("c"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("k1", "k2", "k3", "release_id")]))
    new = assets.where("k2 > 4").withColumn("identity", identity)
    status = F.get(F.array(*[F.lit(s) for s in ("rejected", "accepted", "pending", "superseded")]), (F.col("k1") % 7).cast("int"))
    items = new.where("k1 % 7 < 4").select("identity", status.alias("status"), (F.col("release_id") + F.when(F.col("k1") % 2 == 0, 1).otherwise(0)).alias("accepted_id"))
    return reviews.candidate_outcomes(new, assets.where("k2 <= 4"), items, 1)


@_query(
    "runs",
    sql=""", r AS (SELECT run_id, status, run_id % 3 AS version, run_id % 2 AS queued FROM runs),
    a AS (SELECT *, CASE WHEN version <> 1 THEN 'changed' WHEN status = 'paused' THEN 'unchanged' WHEN status = 'running' THEN 'applied'
      ELSE 'refused' END AS o1, CASE WHEN version = 1 AND status = 'running' THEN 'paused' ELSE status END AS s1, version +
      CASE WHEN version = 1 AND status = 'running' THEN 1 ELSE 0 END AS v1 FROM r),
    b AS (SELECT *, CASE WHEN v1 <> 2 THEN 'changed' WHEN s1 = 'completed' THEN 'unchanged' WHEN queued > 0 THEN 'has_queued_work' WHEN s1 = 'running' THEN 'applied' ELSE 'refused' END AS o2 FROM a)
    SELECT run_id, 1::BIGINT AS seq, 'paused' AS target, o1 AS outcome, s1 AS status, v1 AS version FROM b
    UNION ALL SELECT run_id, 2, 'completed', o2, CASE WHEN o2 = 'applied' THEN 'completed' ELSE s1 END, v1 + CASE WHEN o2 = 'applied' THEN 1 ELSE 0 END FROM b""",
)
def guarded_run_moves(all_runs):
    own = all_runs.select("run_id", "status", (F.col("run_id") % 3).alias("version"), (F.col("run_id") % 2).alias("queued"))
    asked = F.explode(F.array(*[F.struct(F.lit(n).alias("seq"), F.lit(t).alias("target"), F.lit(v).cast("long").alias("version")) for n, t, v in ((1, "paused", 1), (2, "completed", 2))]))
    return runs.moved_runs(own, all_runs.select("run_id", asked.alias("m")).select("run_id", "m.*"))


_RANKS = ", ".join(f"('{t}', {n})" for n, (t, _) in enumerate(dims.ASSET_TYPES))


@_query("assets", sql=f""", t(asset_type, n) AS (VALUES {_RANKS}) SELECT release_id, asset_type, k1, k2, k3, row_number() OVER (PARTITION BY release_id
      ORDER BY n, k1, k2, k3) AS place FROM assets JOIN t USING (asset_type)""")
def media_order(assets):
    return summaries.in_media_order(assets.select("release_id", "asset_type", "k1", "k2", "k3"))


@_query("assets", sql=""" SELECT release_id, k1, k2, k3, greatest(1, round(width * (1024.0::DOUBLE / greatest(width, height)))::INT) AS tw, greatest(1, round(height * (1024.0::DOUBLE / greatest(width, height)))::INT) AS th
      FROM assets WHERE width IS NOT NULL""")
def drawn_page_sizes(assets):
    w, h = summaries.drawn_size(F.col("width"), F.col("height"), 1024)
    return assets.where("width is not null").select("release_id", "k1", "k2", "k3", w.alias("tw"), h.alias("th"))
