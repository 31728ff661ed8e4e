"""Queries of the catalog operators over the bridge relations, and the SQL they are held against."""

from __future__ import annotations

from lodestack.functions import dims, text
from lodestack.operators import claims, coverage, library, linking, matching, planning, preference, runs, vault
from lodestack.plans.bridge import ctes, relation
from lodestack.sources import html
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
BEST = "CASE WHEN width IS NULL OR height IS NULL THEN -1 ELSE width * height END"


def _query(*relations: str, sql: str | None, head: str | None = None):
    """Register a query over bridge relations with its DuckDB twin, where SQL can say it."""

    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(*[relation(spark, sf_dir, r) for r in relations])
        if sql is not None:
            _SQL[f.__name__] = (ctes(*relations) if head is None else head) + sql
        return f

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred asset of each release and type with the release's coverage status."""
    releases, assets = relation(spark, sf_dir, "release_editions"), relation(spark, sf_dir, "assets")
    status = coverage.status(releases, assets).withColumnRenamed("id", "release_id")
    return preference.preferred(assets).join(status, "release_id").select("release_id", "asset_type", "object_hash", "byte_len", "family", "status")


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


_RANKED = f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY release_id, asset_type ORDER BY {BEST} DESC, byte_len DESC, k1, k2, k3) AS position,
  count(*) OVER (PARTITION BY release_id, asset_type) AS n_assets FROM assets)"""


@_query("assets", sql=f", {_RANKED} SELECT release_id, asset_type, n_assets, object_hash, byte_len, width, height, k1, k2, k3 FROM ranked WHERE position = 1")
def preferred_assets(assets):
    return preference.preferred(assets)


@_query(
    "assets",
    sql=f""", r AS (SELECT *, CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN width * height END AS px FROM assets),
    f AS (SELECT *, row_number() OVER w AS position, first_value(px) OVER w AS tp, first_value(byte_len) OVER w AS tb FROM r
      WINDOW w AS (PARTITION BY release_id, asset_type ORDER BY {BEST} DESC, byte_len DESC, k1, k2, k3)),
    g AS (SELECT *, CASE WHEN px IS DISTINCT FROM tp THEN 'more_pixels' WHEN byte_len <> tb THEN 'more_bytes' ELSE 'acquired_first' END AS reason FROM f WHERE position > 1)
    SELECT release_id, asset_type, k1, k2, k3, reason, CASE WHEN reason = 'more_pixels' THEN px ELSE byte_len END AS other FROM g""",
)
def preference_reasons(assets):
    return preference.reasons(assets)


@_query(
    "assets",
    sql=f""", old AS (SELECT *, {BEST} AS p FROM assets WHERE k1 % 2 = 0), new AS (SELECT *, {BEST} AS p FROM assets WHERE k1 % 2 = 1),
    pairs AS (SELECT n.release_id, n.asset_type, n.k1 AS new_k1, n.k2 AS new_k2, n.k3 AS new_k3, o.object_hash AS outranker,
      row_number() OVER (PARTITION BY n.release_id, n.asset_type, n.k1, n.k2, n.k3 ORDER BY o.p DESC, o.byte_len DESC, o.k1, o.k2, o.k3) AS rn
      FROM new n JOIN old o ON o.release_id = n.release_id AND o.asset_type = n.asset_type AND (o.p > n.p OR (o.p = n.p AND o.byte_len >= n.byte_len))
      WHERE NOT EXISTS (SELECT 1 FROM old x WHERE x.release_id = n.release_id AND x.asset_type = n.asset_type AND x.object_hash = n.object_hash))
    SELECT release_id, asset_type, new_k1, new_k2, new_k3, outranker FROM pairs WHERE rn = 2""",
)
def outranked_by_k(assets):
    return preference.outranked(assets.where("k1 % 2 = 0"), assets.where("k1 % 2 = 1"), 2)


@_query("assets", sql=""", p AS (SELECT * FROM assets WHERE source_id <> 'src0') SELECT DISTINCT object_hash FROM assets a WHERE EXISTS (SELECT 1 FROM p
      WHERE p.release_id = a.release_id AND p.k1 = a.k1 AND p.k2 = a.k2 AND p.k3 = a.k3)""")
def retained_originals(assets):
    return vault.with_provenance(assets, assets.where("source_id <> 'src0'"))


@_query("assets", sql=" SELECT DISTINCT object_hash FROM assets WHERE source_id <> 'src0' AND object_hash NOT IN (SELECT object_hash FROM assets WHERE k3 % 3 = 0)")
def originals_without_recipe(assets):
    return vault.without_recipe(vault.with_provenance(assets, assets.where("source_id <> 'src0'")), assets.where("k3 % 3 = 0"))


_PROFILE_ROWS = ", ".join(f"('{f}', '{dims.PROFILE_NAMES[n]}', {n}, '{t}')" for f, ls in dims.PROFILES.items() for n, ts in enumerate(ls) for t in ts)
_FAMILY_ROWS = ", ".join(f"('{p.lower()}', '{f}')" for f, ps in dims.PLATFORMS.items() for p in ps)
_COVERED = f""", adds(family, profile, position, asset_type) AS (VALUES {_PROFILE_ROWS}), known(platform, family) AS (VALUES {_FAMILY_ROWS}),
    steps AS (SELECT DISTINCT family, profile, position FROM adds),
    profiles AS (SELECT s.family, s.profile, s.position, a.asset_type FROM steps s JOIN adds a ON a.family = s.family AND a.position <= s.position),
    rel AS (SELECT id, CASE WHEN trim(r.platform) LIKE '%(Digital)' OR trim(r.platform) LIKE '%(PSN)' THEN 'digital_only' ELSE k.family END AS family
      FROM release_editions r LEFT JOIN known k ON k.platform = lower(trim(r.platform))),
    have AS (SELECT DISTINCT release_id, asset_type FROM assets),
    per AS (SELECT id, family, profile, position, count(*) AS required, count(*) FILTER (WHERE h.release_id IS NULL) AS missing
      FROM rel JOIN profiles p USING (family) LEFT JOIN have h ON h.release_id = rel.id AND h.asset_type = p.asset_type GROUP BY ALL)"""


@_query("release_editions", "assets", sql=_COVERED + " SELECT * FROM per")
def coverage_profiles(releases, assets):
    return coverage.by_profile(releases, assets)


@_query(
    "release_editions",
    "assets",
    sql=_COVERED
    + """, upto AS (SELECT id, profile, position, bool_and(missing = 0) OVER (PARTITION BY id ORDER BY position ROWS UNBOUNDED PRECEDING) AS done FROM per),
    last AS (SELECT id, max_by(profile, position) AS profile FROM upto WHERE done GROUP BY id)
    SELECT rel.id, family, CASE WHEN family IS NOT NULL THEN coalesce(profile, 'none') END AS status FROM rel LEFT JOIN last ON last.id = rel.id""",
)
def coverage_status(releases, assets):
    return coverage.status(releases, assets)


@_query(
    "assets",
    sql=""", c AS (SELECT release_id, asset_type, k1, k2, k3, unnest([{'r': 'width', 'need': 400, 'got': width}, {'r': 'height', 'need': 300, 'got': height}, {'r': 'pixels', 'need': 120000, 'got': width * height},
      {'r': 'bytes', 'need': 2000000, 'got': byte_len}, {'r': 'longest_edge', 'need': 500, 'got': CASE WHEN width IS NOT NULL AND height IS NOT NULL THEN greatest(width, height) END}]) AS x FROM assets)
    SELECT release_id, asset_type, k1, k2, k3, x.r AS requirement, x.need AS required, x.got AS found FROM c WHERE NOT coalesce(x.got >= x.need, false)""",
)
def quality_shortfalls(assets):
    return preference.shortfalls(assets, 400, 300, 120_000, 2_000_000, 500)


_LATEST = """latest AS (SELECT release_id, source_id, value, k1, k2, k3 FROM (SELECT *, row_number() OVER (PARTITION BY release_id, source_id
      ORDER BY k1 DESC, k2 DESC, k3 DESC) AS rn FROM assertions) WHERE rn = 1)"""


@_query(
    "assertions",
    sql=f""", {_LATEST}, keyed AS (SELECT *, lower(regexp_replace(value, '\\s', '', 'g')) AS key FROM latest),
    votes AS (SELECT release_id, key, count(*) AS agree, min((k1, k2, k3, source_id)) AS seen, arg_min(value, (k1, k2, k3, source_id)) AS value FROM keyed GROUP BY release_id, key),
    best AS (SELECT *, sum(agree) OVER (PARTITION BY release_id) AS claims, row_number() OVER (PARTITION BY release_id ORDER BY agree DESC, seen) AS rn FROM votes)
    SELECT release_id, trim(value) AS value, agree, cast(claims AS BIGINT) AS claims, cast((agree * 100) // claims AS BIGINT) AS confidence FROM best WHERE rn = 1""",
)
def canonical_values(assertions):
    return claims.canonical(assertions)


@_query("assertions", sql=f", {_LATEST} SELECT release_id, source_id, value FROM latest")
def latest_title_per_source(assertions):
    return claims.latest(assertions).select("release_id", "source_id", "value")


_SUMMARY = """, firsts AS (SELECT release_id, asset_type, min((k1, k2, k3)) AS seen FROM assets GROUP BY ALL),
    types AS (SELECT release_id, list(asset_type ORDER BY seen, asset_type) AS asset_types FROM firsts GROUP BY release_id),
    srcs AS (SELECT release_id, list(source_id ORDER BY source_id) AS sources FROM (SELECT release_id, source_id FROM assets UNION SELECT release_id, source_id FROM assertions) GROUP BY release_id),
    summary AS (SELECT r.*, coalesce(asset_types, []) AS asset_types, coalesce(sources, []) AS sources FROM release_editions r LEFT
      JOIN types t ON t.release_id = r.id LEFT JOIN srcs s ON s.release_id = r.id)"""


@_query("release_editions", "assets", "assertions", sql=_SUMMARY + " SELECT id, title, platform, array_to_string(asset_types, ',') AS asset_types, array_to_string(sources, ',') AS sources FROM summary")
def library_summary(releases, assets, assertions):
    s = library.summaries(releases, assets, assertions)
    return s.select("id", "title", "platform", F.array_join("asset_types", ",").alias("asset_types"), F.array_join("sources", ",").alias("sources"))


@_query(
    "release_editions",
    "assets",
    sql=""" SELECT r.id, r.title, count(a.release_id) AS n_assets, coalesce(string_agg(a.asset_type || ':' || a.object_hash || ':' || cast(a.byte_len AS VARCHAR), '|'
      ORDER BY a.k1, a.k2, a.k3), '') AS assets
    FROM release_editions r LEFT JOIN assets a ON a.release_id = r.id GROUP BY r.id, r.title""",
)
def library_entries_nested(releases, assets):
    flat = F.transform("assets", lambda a: F.concat_ws(":", a["asset_type"], a["object_hash"], a["byte_len"].cast("string")))
    return library.entries(releases, assets).select("id", "title", F.coalesce(F.size("assets"), F.lit(0)).cast("long").alias("n_assets"), F.coalesce(F.array_join(flat, "|"), F.lit("")).alias("assets"))


@_query(
    "release_editions",
    "assets",
    "assertions",
    sql=_SUMMARY
    + """ SELECT id, title, platform, region, edition FROM summary WHERE contains(lower(title), 're') AND lower(platform) IN ('nintendo - game boy', 'sony - playstation', 'mame')
    AND len(list_filter(string_split(region, ','), lambda x: lower(trim(x)) IN ('usa', 'japan'))) > 0 AND list_has_any(asset_types, ['box_front', 'disc'])""",
)
def library_search(releases, assets, assertions):
    s = library.summaries(releases, assets, assertions)
    return library.search(s, " RE ", ["nintendogameboy", "Sony PlayStation", "MAME"], ["usa", "Japan"], ["box_front", "disc"]).select("id", *library.SORT)


@_query("release_editions", sql=""" SELECT id, title, platform, region, edition FROM release_editions
      WHERE (lower(title), lower(platform), lower(region), lower(edition), id) > (SELECT (lower(title), lower(platform), lower(region), lower(edition), id)
      FROM release_editions WHERE id = 7) ORDER BY lower(title), lower(platform), lower(region), lower(edition), id LIMIT 50""")
def library_page_keyset(releases):
    return library.page(releases, 50, releases.where("id = 7")).select("id", *library.SORT)


@_query("release_editions", "assets", sql=""" SELECT lower(regexp_replace(platform, '[^\\p{L}\\p{N}]', '', 'g')) AS platform_key, min(trim(platform)) AS platform FROM release_editions
      WHERE id IN (SELECT release_id FROM assets) GROUP BY 1""")
def platforms_with_media(releases, assets):
    return library.platforms_with_media(releases, assets)


@_query("release_editions", "assets", sql=""" SELECT release_id, title, asset_type, k1, k2, k3 FROM (SELECT * FROM assets ORDER BY k1 DESC, k2 DESC, release_id DESC, k3 DESC LIMIT 24) a
      JOIN release_editions r ON r.id = a.release_id""")
def latest_media(releases, assets):
    return library.latest_media(releases, assets, 24)


_COUNTRY = ", ".join(f"('{c}', '{r}')" for c, r in dims.REGION_OF_COUNTRY.items())
#: Every signature against every release: nothing is pruned here.
_PAIRS = f""", country(c, r) AS (VALUES {_COUNTRY}),
    holds AS (SELECT a.region AS a, b.region AS b,
      list_has_any(string_split(lower(a.region), ', '), string_split(lower(b.region), ', ')) AS shared,
      list_contains(string_split(lower(a.region), ', '), 'world') OR list_contains(string_split(lower(b.region), ', '), 'world')
      OR EXISTS (SELECT 1 FROM country WHERE list_contains(string_split(lower(a.region), ', '), c) AND list_contains(string_split(lower(b.region), ', '), country.r))
      OR EXISTS (SELECT 1 FROM country WHERE list_contains(string_split(lower(b.region), ', '), c) AND list_contains(string_split(lower(a.region), ', '), country.r)) AS contained
      FROM (SELECT DISTINCT region FROM candidates) a, (SELECT DISTINCT region FROM release_editions) b),
    sig AS (SELECT DISTINCT title, platform, region, edition FROM candidates),
    pairs AS (SELECT s.title AS ct, s.platform AS cp, s.region AS cr, s.edition AS ce, r.id AS release_id, r.game_id, lower(r.region) AS rr, r.edition AS re,
      CASE WHEN coalesce(trim(s.title), '') = '' OR coalesce(trim(r.title), '') = '' THEN 0 WHEN lower(trim(s.title)) = lower(trim(r.title)) THEN 50 ELSE -50 END AS e1,
      CASE WHEN s.platform = '' OR r.platform = '' THEN 0 WHEN lower(s.platform) = lower(r.platform) THEN 30 ELSE -30 END AS e2,
      CASE WHEN lower(s.region) = 'unknown' OR lower(r.region) = 'unknown' THEN 0 WHEN shared THEN 15 WHEN contained THEN 10 ELSE -15 END AS e3,
      CASE WHEN lower(s.edition) = 'unspecified' OR lower(r.edition) = 'unspecified' THEN 0 WHEN lower(s.edition) = lower(r.edition) THEN 5 ELSE -5 END AS e4
      FROM sig s JOIN release_editions r ON true JOIN holds ON holds.a = s.region AND holds.b = r.region),
    scored AS (SELECT *, greatest(0, least(100, e1 + e2 + e3 + e4)) AS score FROM pairs)"""


def _matches(high: int, medium: int) -> str:
    return _PAIRS + f""", top AS (SELECT *, max(score) OVER (PARTITION BY ct, cp, cr, ce) AS best FROM scored), tied AS (SELECT * FROM top WHERE score = best),
    one AS (SELECT *, min(game_id) OVER s = max(game_id) OVER s AS same FROM tied WINDOW s AS (PARTITION BY ct, cp, cr, ce)),
    pick AS (SELECT *, row_number() OVER (PARTITION BY ct, cp, cr, ce ORDER BY CASE WHEN same AND lower(re) <> 'standard' THEN 1 ELSE 0 END,
      CASE WHEN same THEN CASE rr WHEN 'world' THEN 0 WHEN 'usa' THEN 1 WHEN 'europe' THEN 2 WHEN 'japan' THEN 3 ELSE 4 END END,
      CASE WHEN same THEN rr END, release_id) AS rn FROM one),
    named AS (SELECT candidate_id, release_id, score,
      CASE WHEN score < {medium} THEN 'low' WHEN NOT same OR least(e2, e3, e4) < 0 THEN 'medium' WHEN score >= {high} THEN 'high'
      ELSE 'medium' END AS confidence
      FROM candidates c JOIN pick p ON c.title = ct AND c.platform = cp AND c.region = cr AND c.edition = ce WHERE rn = 1)"""


@_query("candidates", "release_editions", sql=_matches(80, 50) + " SELECT * FROM named WHERE confidence <> 'low'")
def match_candidates(candidates, releases):
    return matching.best(candidates, releases)


@_query("candidates", "release_editions", sql=_matches(80, 50) + " SELECT * FROM named")
def match_every_candidate(candidates, releases):
    return matching.matched(candidates, releases)


@_query("candidates", "release_editions", sql=_matches(40, 20) + " SELECT * FROM named")
def match_low_policy(candidates, releases):
    return matching.matched(candidates, releases, 40, 20)


@_query(
    "candidates",
    "release_editions",
    sql=_PAIRS
    + """, per AS (SELECT ct, cp, cr, ce, count(*) AS competing, max(score) AS best, min(release_id) AS lowest_id FROM scored WHERE score >= 50 GROUP BY ALL)
    SELECT candidate_id, competing, best, lowest_id FROM candidates c JOIN per ON c.title = ct AND c.platform = cp AND c.region = cr AND c.edition = ce""",
)
def competing_matches(candidates, releases):
    return matching.competing(candidates, releases)


@_query(
    "candidates",
    "release_editions",
    "work",
    sql=_PAIRS
    + """, open AS (SELECT title, platform, region, edition, count(*) AS items FROM candidates WHERE candidate_id IN (SELECT work_id FROM work
      WHERE review_status IN ('pending', 'deferred')) GROUP BY ALL)
    SELECT release_id, cast(sum(items) AS BIGINT) AS items FROM scored JOIN open ON title = ct AND platform = cp AND region = cr AND edition = ce WHERE score >= 50 GROUP BY release_id""",
)
def needs_review(candidates, releases, work):
    return matching.competing_releases(runs.undecided_candidates(candidates, work), releases)


_COUNTERS = """, n AS (SELECT r.run_id, r.status, count(*) FILTER (WHERE state = 'queued') AS queued, count(*) FILTER (WHERE state = 'parked') AS parked, count(*) FILTER (WHERE state = 'done') AS done,
    count(*) FILTER (WHERE state = 'parked' AND review_status IN ('pending', 'deferred')) AS needs_review, count(*) FILTER (WHERE unavailable) AS unavailable, count(*) FILTER (WHERE skipped) AS skipped,
    count(*) FILTER (WHERE state = 'done' AND review_status = 'rejected') AS dismissed FROM runs r LEFT JOIN work w ON w.run_id = r.run_id GROUP BY r.run_id, r.status)"""


@_query("runs", "work", sql=_COUNTERS + " SELECT * FROM n")
def run_counters(all_runs, work):
    return runs.counters(all_runs, work)


@_query(
    "runs",
    "work",
    sql=_COUNTERS
    + """, s AS (SELECT run_id, avg(share) AS m FROM (SELECT run_id, source_id, count(*) FILTER (WHERE state = 'done') / count(*) AS share FROM work GROUP BY ALL) GROUP BY run_id)
    SELECT n.run_id, greatest(done - unavailable - skipped - dismissed, 0) AS acquired, round(coalesce(m, 0.0), 9) AS mean_share, round(CASE WHEN queued + parked + done > 0 THEN done / (queued + parked + done)
      ELSE 0.0 END, 9) AS done_share FROM n LEFT JOIN s ON s.run_id = n.run_id""",
)
def run_progress(all_runs, work):
    return runs.progress(all_runs, work).withColumns({c: F.round(c, 9) for c in ("mean_share", "done_share")})


@_query("runs", "work", sql=""", q AS (SELECT w.run_id, row_number() OVER (PARTITION BY w.run_id, source_id ORDER BY work_id) AS turn, work_id, source_id FROM work w
      JOIN runs r ON r.run_id = w.run_id AND status = 'running' WHERE state = 'queued' AND source_id <> 'src3') SELECT * FROM q WHERE turn <= 2""")
def fair_queue(all_runs, work):
    return runs.fair_queue(all_runs, work, 2, ["src3"])


@_query("runs", "work", sql=""", s AS (SELECT w.run_id, work_id,
      CASE WHEN status = 'cancelled' THEN NULL WHEN status = 'completed' AND state = 'queued' THEN 'completed_run' WHEN state = 'parked' AND review_status NOT IN ('pending', 'deferred') THEN 'closed_review' END AS reason
      FROM work w JOIN runs r ON r.run_id = w.run_id WHERE state <> 'done') SELECT * FROM s WHERE reason IS NOT NULL""")
def stale_work(all_runs, work):
    return runs.stale(all_runs, work)


@_query("work", sql=""" SELECT work_id, review_status, (SELECT count(*) FROM work WHERE review_status IN ('pending', 'deferred')) AS total FROM work
      WHERE review_status IN ('pending', 'deferred') ORDER BY work_id LIMIT 50 OFFSET 100""")
def undecided_page(work):
    return runs.undecided_page(work, 50, 100)


@_query("source_failures", sql=""", f AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY sequence DESC) AS rank, sequence,
      CASE WHEN cast(json_extract(props, '$.k') AS INT) % 2 = 0 THEN 'discovery'
      ELSE 'download' END AS stage, count(*) OVER (PARTITION BY source_id) AS failures FROM source_failures) SELECT * FROM f WHERE rank <= 3""")
def source_failures(log):
    return runs.failures(log, 3)


@_query("assets", sql=" SELECT DISTINCT object_hash FROM assets WHERE k3 % 2 = 0 AND object_hash NOT IN (SELECT object_hash FROM assets WHERE k1 % 3 = 0)")
def vault_missing(assets):
    return vault.missing(assets.where("k3 % 2 = 0"), assets.where("k1 % 3 = 0"))


@_query("assets", sql=" SELECT DISTINCT object_hash FROM assets WHERE k1 % 3 = 0 AND object_hash NOT IN (SELECT object_hash FROM assets WHERE k3 % 2 = 0)")
def vault_unreferenced(assets):
    return vault.unreferenced(assets.where("k3 % 2 = 0"), assets.where("k1 % 3 = 0"))


@_query("assets", sql=""", d AS (SELECT DISTINCT md5('d' || cast(release_id AS VARCHAR) || asset_type) AS derived_hash, object_hash
      FROM assets) SELECT derived_hash, count(*) AS originals, bool_and(object_hash IN (SELECT object_hash FROM assets WHERE k3 % 2 = 0)) AS in_use FROM d
      GROUP BY derived_hash""")
def derived_in_use(assets):
    derived = assets.select(F.md5(F.concat(F.lit("d"), F.col("release_id").cast("string"), "asset_type").cast("binary")).alias("derived_hash"), "object_hash")
    return vault.derived_in_use(derived, assets.where("k3 % 2 = 0"))


@_query(
    "release_editions",
    "assets",
    sql=f""", label(asset_type, label) AS (VALUES {", ".join(f"('{t}', '{x.replace('/', '-')}')" for t, x in dims.LABELS.items())}),
    p AS (SELECT release_id, a.asset_type, k1, k2, k3, object_hash, byte_len, platform || '/' || title || CASE WHEN region = 'Unknown' THEN '' ELSE ' (' || region || ')' END
        || CASE WHEN edition = 'Standard' THEN '' ELSE ' (' || edition || ')' END || '/' || label AS folder,
      CASE WHEN original_filename LIKE 'scan%' THEN original_filename WHEN original_filename LIKE 'a:b%' THEN 'a-b-c.jpeg' WHEN original_filename = 'con.tif' THEN '_con.tif'
        ELSE 'cover' || CASE media_type WHEN 'image/png' THEN '.png' WHEN 'image/tiff' THEN '.tif' WHEN 'application/pdf' THEN '.pdf' ELSE '' END END AS file
      FROM assets a JOIN release_editions r ON r.id = release_id JOIN label USING (asset_type)),
    h AS (SELECT *, count(*) OVER (PARTITION BY lower(folder || '/' || file)) AS holders FROM p)
    SELECT release_id, asset_type, k1, k2, k3, object_hash, byte_len, folder || '/' ||
      CASE WHEN holders = 1 THEN file WHEN contains(file, '.') THEN regexp_replace(file, '\\.([^.]*)$', ' (' || object_hash[1:8] || ').\\1')
      ELSE file || ' (' || object_hash[1:8] || ')' END AS path FROM h""",
)
def export_paths(releases, assets):
    return library.export_paths(releases, assets)


@_query("assertions", sql=""" SELECT release_id, k1, k2, k3, lower(regexp_replace(value, '[^\\p{L}\\p{N}]', '', 'g')) AS name_key, lower(regexp_replace(value, '\\s', '', 'g')) AS comparable
      FROM assertions""")
def title_keys(assertions):
    return assertions.select("release_id", "k1", "k2", "k3", text.name_key(F.col("value")).alias("name_key"), text.comparable(F.col("value")).alias("comparable"))


#: First tags by id: what is a region and what is not.
_FIRST = ["USA", "Atlantis", "Rev 1", "Beta 2", "En,Fr", "1996-05-01", "Disc 1", "v1.2", "Revision B", "rev 2", "Betamax", "Proto-1"]
_IS_REGION = [0, 1, 9, 10]
_NAMES = "SELECT id, title, edition, id % 12 AS k, CASE id % 12 " + " ".join(f"WHEN {n} THEN '{t}'" for n, t in enumerate(_FIRST)) + " END AS tag FROM release_editions"


@_query(
    "release_editions",
    sql=f""", n AS ({_NAMES}) SELECT id, title, CASE WHEN k IN (0, 1, 9, 10) THEN tag ELSE 'Unknown' END AS region,
    CASE WHEN k IN (0, 1, 9, 10) THEN CASE WHEN id % 5 = 0 THEN 'Standard' ELSE edition END ELSE tag || CASE WHEN id % 5 = 0 THEN '' ELSE ' · ' || edition END END AS edition,
    CASE WHEN k IN (2, 7, 8) THEN tag END AS revision FROM n""",
)
def release_name_parse(releases):
    first = F.get(F.array(*[F.lit(t) for t in _FIRST]), (F.col("id") % 12).cast("int"))
    name = F.concat("title", F.lit(" ("), first, F.lit(")"), F.when(F.col("id") % 5 == 0, "").otherwise(F.concat(F.lit(" ("), F.col("edition"), F.lit(")"))))
    return releases.select("id", text.parsed_release_name(name).alias("n")).select("id", "n.*")


@_query("assets", sql=""" SELECT release_id AS record_id, CASE WHEN bool_and(width IS NOT NULL) THEN string_agg(DISTINCT sha1(object_hash), ','
      ORDER BY sha1(object_hash)) END AS dump_set FROM assets GROUP BY release_id""")
def dump_sets(assets):
    return linking.dump_sets(assets.select(F.col("release_id").alias("record_id"), F.when(F.col("width").isNotNull(), F.upper(F.sha1(F.col("object_hash").cast("binary")))).alias("sha1")))


_REC = """, rec AS (SELECT id AS record_id, 'src' || cast(id % 3 AS VARCHAR) AS own,
      CASE WHEN id % 4 = 0 THEN title || region END AS dump_set, lower(trim(title)) AS t, lower(platform) AS p, lower(region) AS r, lower(edition) AS e
      FROM release_editions WHERE id % 2 = 0),
    kn AS (SELECT id AS release_id, 'src' || cast(id % 3 AS VARCHAR) AS source_id,
      CASE WHEN id % 5 = 0 THEN title || region END AS dump_set, lower(trim(title)) AS t, lower(platform) AS p, lower(region) AS r, lower(edition) AS e
      FROM release_editions WHERE id % 2 = 1),
    dm AS (SELECT DISTINCT record_id, own, release_id FROM rec JOIN kn USING (p, r, e) WHERE rec.dump_set = kn.dump_set AND own <> source_id),
    tm AS (SELECT DISTINCT record_id, own, release_id FROM rec JOIN kn USING (p, r, e, t) WHERE own <> source_id AND record_id NOT IN (SELECT record_id FROM dm)),
    m AS (SELECT *, 'dumps' AS evidence FROM dm UNION ALL SELECT *, 'title' FROM tm),
    f AS (SELECT *, NOT EXISTS (SELECT 1 FROM kn WHERE kn.release_id = m.release_id AND kn.source_id = m.own) AS free FROM m),
    g AS (SELECT record_id, evidence, count(*) AS n, count(*) FILTER (WHERE free) AS nf, min(release_id) FILTER (WHERE free) AS release_id FROM f GROUP BY ALL)
    SELECT rec.record_id, coalesce(evidence, 'none') AS evidence, CASE WHEN n = 1 AND nf = 1 THEN 'linked' WHEN nf > 0 THEN 'uncertain'
      ELSE 'unlinked' END AS outcome, CASE WHEN n = 1 AND nf = 1 THEN release_id END AS release_id FROM rec LEFT JOIN g USING (record_id)"""


@_query("release_editions", sql=_REC)
def link_by_dumps_then_title(releases):
    source = F.concat(F.lit("src"), (F.col("id") % 3).cast("string")).alias("source_id")
    dump = lambda n: F.when(F.col("id") % n == 0, F.concat("title", "region")).alias("dump_set")
    parts = ["title", "platform", "region", "edition"]
    records = releases.where("id % 2 = 0").select(F.col("id").alias("record_id"), source, dump(4), *parts)
    known = releases.where("id % 2 = 1").select(F.col("id").alias("release_id"), source, dump(5), *parts)
    return linking.link(records, known)


@_query("release_editions", "candidates", sql=""", l AS (SELECT lower(trim(title)) || platform || region || edition AS k, count(*) AS n, min(id) AS listed_id FROM release_editions
      GROUP BY 1) SELECT candidate_id AS id, lower(trim(title)) || platform || region || edition AS title, listed_id FROM candidates
      JOIN l ON l.k = lower(trim(title)) || platform || region || edition WHERE n = 1""")
def unique_title_join(releases, candidates):
    key = F.concat(text.normalised(F.col("title")), "platform", "region", "edition").alias("title")
    out = library.unique_titles(candidates.select(F.col("candidate_id").alias("id"), key), releases.select("id", key))
    return out.select("id", "title", "listed_id")


@_query("release_editions", sql=""", o AS (SELECT *, bool_or(platform = 'Nintendo - Game Boy') OVER (PARTITION BY title, region) AS any_own
      FROM release_editions) SELECT id, title, region, platform FROM o WHERE platform = 'Nintendo - Game Boy' OR NOT any_own""")
def fallback_join(releases):
    return library.own_or_general(releases, F.col("platform") == "Nintendo - Game Boy", ["title", "region"]).select("id", "title", "region", "platform")


@_query("release_editions", sql=""", g AS (SELECT lower(regexp_replace(platform, '[^\\p{L}\\p{N}]', '', 'g')) AS platform_key, lower(trim(title)) AS name, min(title) AS title
      FROM release_editions GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY platform_key
      ORDER BY name) AS rn, count(*) OVER (PARTITION BY platform_key) AS cnt FROM g) SELECT platform_key, title, rn FROM r
      WHERE rn <= least(10, (cnt * 15 + 99) // 100)""")
def every_game_first_n(releases):
    return library.first_games(releases, 10, 15)


_LANGUAGES = ", ".join(f"('{r.lower()}', '{lang}')" for r, lang in dims.LANGUAGE_OF_REGION.items())


@_query(
    "release_editions",
    sql=f""", implied(r, l) AS (VALUES {_LANGUAGES}) SELECT id, region FROM release_editions WHERE CASE WHEN id % 4 = 0 THEN true WHEN id % 4 = 1 THEN false
    ELSE EXISTS (SELECT 1 FROM implied WHERE l = 'De' AND list_contains(string_split(lower(region), ', '), r)) END""",
)
def region_language_filter(releases):
    tag = F.when(F.col("id") % 4 == 0, " (En,Fr,De) (Unl)").when(F.col("id") % 4 == 1, " (Zh-Hant)").otherwise(" (Alt)")
    named = releases.withColumn("name", F.concat("title", F.lit(" ("), "region", F.lit(")"), tag))
    return library.speaking(named, ["de"]).select("id", "region")


@_query("release_editions", sql=" SELECT id, region FROM release_editions WHERE region IN ('Germany', 'World', 'USA, Europe', 'Europe')")
def region_selection(releases):
    return library.in_regions(releases, [" germany", "EUROPE"]).select("id", "region")


@_query("assets", sql=""", cap AS (SELECT DISTINCT source_id, asset_type FROM assets
      WHERE k2 = 3 AND k3 % 4 = 1), ask(selector) AS (VALUES ('any'), ('packaging'), ('box_front'), ('manual'), ('insert'), ('disc')), h AS (SELECT selector, source_id
      FROM ask JOIN cap ON selector = asset_type UNION SELECT 'any', source_id FROM cap) SELECT ask.selector, coalesce(string_agg(source_id, ','
      ORDER BY source_id), '') AS sources, count(source_id) > 0 AS covered FROM ask LEFT JOIN h ON h.selector = ask.selector GROUP BY ask.selector""")
def plan_coverage(assets):
    asked = assets.sparkSession.createDataFrame([(x,) for x in ("any", "packaging", "box_front", "manual", "insert", "disc")], "selector string")
    return planning.covered(asked, assets.where("k2 = 3 and k3 % 4 = 1").select("source_id", "asset_type").distinct())


@_query("assets", "assertions", sql=" SELECT release_id, source_id FROM assets UNION SELECT release_id, source_id FROM assertions")
def source_union(assets, assertions):
    return assets.select("release_id", "source_id").union(assertions.select("release_id", "source_id")).distinct()


@_query("assets", sql=" SELECT object_hash, asset_type FROM assets WHERE k1 % 3 = 0 EXCEPT SELECT object_hash, asset_type FROM assets WHERE k3 % 2 = 0")
def store_difference(assets):
    return assets.where("k1 % 3 = 0").select("object_hash", "asset_type").subtract(assets.where("k3 % 2 = 0").select("object_hash", "asset_type"))


@_query("release_editions", sql=""", w AS (SELECT DISTINCT title, CASE WHEN id % 3 = 0 THEN platform END AS only_platform FROM release_editions
      WHERE id % 17 = 0) SELECT t.platform, t.title FROM (SELECT DISTINCT platform, title FROM release_editions) t JOIN w ON w.title = t.title
      WHERE only_platform IS NULL OR only_platform = t.platform""")
def request_targets(releases):
    wanted = releases.where("id % 17 = 0").select("title", F.when(F.col("id") % 3 == 0, F.col("platform")).alias("only_platform")).distinct()
    return planning.targets(releases, wanted)


@_query("candidates", sql=" SELECT candidate_id, " + " || '|' || ".join(f"cast(strlen(lower(trim({c}))) AS VARCHAR) || ':' || lower(trim({c}))" for c in ("title", "platform", "region", "edition")) + " AS identity FROM candidates")
def identity_keys(candidates):
    return candidates.select("candidate_id", text.identity(*[F.col(c) for c in ("title", "platform", "region", "edition")]).alias("identity"))


@_query("work", sql=" SELECT run_id, source_id, state, min(work_id) AS work_id, count(*) AS offered FROM work GROUP BY ALL")
def work_dedupe(work):
    return runs.dedupe(work, ["run_id", "source_id", "state"])


def _over(table: str, sql: str):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        _SQL[f.__name__] = sql
        return f

    return add


@_over("pages", "SELECT page_id, url, regexp_matches(url, '^[a-z]+://[^/?#@]+([/][^?#]*)?$') AS safe FROM pages")
def safe_locators(pages):
    return pages.select("page_id", "url", text.url_is_safe(F.col("url")).alias("safe"))


@_over("pages", """SELECT page_id, unnest(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages""")
def html_links(pages):
    return html.links(pages)


@_over("pages", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+)://', 1) AS scheme FROM pages""")
def url_parts(pages):
    return pages.select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PROTOCOL")).alias("scheme"))
