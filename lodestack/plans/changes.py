"""Queries of changes to the catalog and of the order of work, registered with the others."""

from __future__ import annotations

from lodestack.functions import text
from lodestack.functions.blake3 import blake3
from lodestack.operators import claims, importing, library, linking, planning, runs, snapshots, vault
from lodestack.plans.bridge import ctes
from lodestack.plans.registry import _QUERIES, _query
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _source(n: int, c: str = "id"):
    return F.concat(F.lit("src"), (F.col(c) % n).cast("string"))


def _nothing(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that the planner knows to be empty: its joins and the Python workers of its rows go."""
    columns = [c.rsplit(" ", 1) for c in schema.split(", ")]
    return spark.range(0).select(*[F.lit(None).cast({"long": "bigint"}.get(t, t.replace("<long>", "<bigint>"))).alias(n) for n, t in columns]).where(F.lit(False))


def _import(releases: DataFrame) -> tuple[DataFrame, ...]:
    """Records of five sources in the order of their ids, on an empty catalog."""
    spark = releases.sparkSession
    region, edition = F.when(F.col("id") % 3 == 0, " USA ").otherwise("usa"), F.when(F.col("id") % 8 == 0, "Deluxe").otherwise("Standard")
    dumps = F.when(F.col("id") % 3 == 1, (F.col("id") % 12).cast("string"))
    rows = releases.select(
        (F.col("id") + 1_000_000_000).alias("seq"), _source(5).alias("source_id"), F.col("id").cast("string").alias("record_id"), F.lit("f").alias("location"), "title",
        "platform", region.alias("region"), edition.alias("edition"), dumps.alias("dump_set")
    )
    editions = _nothing(spark, "id long, game_id long, platform string, region string, edition string")
    claims = _nothing(spark, "release_id long, source_id string, location string, field string, qualifier string, value string, seq long")
    sets = _nothing(spark, "source_id string, record_id string, release_id long, dump_set string")
    return editions, claims, sets, rows


#: Record by record, on the list of those before it.
_FOLD = """, rec AS (SELECT row_number() OVER (ORDER BY id) AS k, id + 1000000000 AS seq, 'src' || (id % 5)::VARCHAR AS s, lower(trim(title)) AS t, lower(trim(platform)) AS p, 'usa' AS r,
      CASE WHEN id % 8 = 0 THEN 'deluxe' ELSE 'standard' END AS e, CASE WHEN id % 3 = 1 THEN (id % 12)::VARCHAR END AS d FROM release_editions),
    fold AS (
      SELECT 0::BIGINT AS k, []::STRUCT(seq BIGINT, s VARCHAR, t VARCHAR, p VARCHAR, e VARCHAR, d VARCHAR, rel BIGINT, game BIGINT, outcome VARCHAR)[] AS st
      UNION ALL
      SELECT k, list_append(st, {'seq': seq, 's': s, 't': t, 'p': p, 'e': e, 'd': d, 'rel': coalesce(link, there, seq), 'game': coalesce(link_game, best, seq),
        'outcome': CASE WHEN link IS NOT NULL THEN 'linked' WHEN there IS NOT NULL THEN 'joined' ELSE 'founded' END}) FROM (
        SELECT *, CASE WHEN link IS NULL THEN list_min(list_transform(list_filter(st, lambda x: x.game = best AND x.p = p AND x.e = e), lambda x: x.rel)) END AS there FROM (
          SELECT *, CASE WHEN link IS NULL THEN list_sort(list_transform(list_filter(named, lambda x: len(list_filter(near, lambda y: y.game = x.game AND y.e = e AND y.s <> s)) = 0), lambda x: {'o': x.s <> s, 'rel': x.rel, 'g': x.game}))[1].g END AS best
      FROM (
            SELECT *, list_filter(near, lambda x: x.t = t) AS named, CASE WHEN len(cand) = 1 AND len(free) = 1 THEN free[1] END AS link,
      CASE WHEN len(cand) = 1 AND len(free) = 1 THEN list_filter(st, lambda x: x.rel = free[1])[1].game END AS link_game FROM (
              SELECT *, list_filter(cand, lambda c: len(list_filter(st, lambda x: x.rel = c AND x.s = s)) = 0) AS free FROM (
                SELECT *, CASE WHEN len(dumped) > 0 THEN dumped ELSE list_distinct(list_transform(list_filter(near, lambda x: x.t = t AND x.s <> s AND x.e = e), lambda x: x.rel)) END AS cand FROM (
                  SELECT *, list_distinct(list_transform(list_filter(near, lambda x: x.d = d AND x.s <> s AND x.e = e), lambda x: x.rel)) AS dumped FROM (
                    SELECT rec.*, st, list_filter(st, lambda x: x.p = rec.p) AS near FROM fold JOIN rec ON rec.k = fold.k + 1))))))))
    SELECT x.seq, x.rel AS release_id, x.game AS game_id, x.outcome FROM (SELECT unnest(st) AS x FROM fold WHERE k = (SELECT max(k) FROM fold))"""


@_query("release_editions", head=ctes("release_editions").replace("WITH ", "WITH RECURSIVE ", 1), sql=_FOLD)
def reference_import(releases):
    return importing.placed(*_import(releases))


@_query("release_editions", sql=None)
def reference_reviews(releases):
    editions, claims, sets, rows = _import(releases)
    items = _nothing(releases.sparkSession, "source_id string, record_id string, release_id long, evidence string, candidates array<long>, status string")
    return importing.reference_import(editions, claims, sets, items, rows)["items"]


_MERGES = """, m AS (SELECT id AS a, id - 1 AS b, id AS seq FROM release_editions WHERE id % 9 IN (1, 2, 4) AND id > 9)"""


def _merges(releases):
    """Chains of up to two steps: 2 to 1 to 0, and 4 to 3, of nine."""
    return releases.where("id % 9 in (1, 2, 4) and id > 9").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("into_id"), F.col("id").alias("seq"))


def _claims(assets):
    own = assets.groupBy("release_id", "source_id", F.col("media_type").alias("value")).agg(F.min("original_filename").alias("location"), F.min("k1").alias("seq"))
    return own.select("release_id", "source_id", "location", F.lit("f").alias("field"), F.lit("").alias("qualifier"), "value", "seq")


@_query(
    "release_editions",
    "assets",
    sql=_MERGES
    + """, c AS (SELECT release_id, source_id, media_type AS value, min(original_filename) AS location, min(k1) AS seq FROM assets GROUP BY ALL),
    x AS (SELECT c.*, coalesce(n.b, m.b, release_id) AS root, CASE WHEN m.a IS NULL THEN [] WHEN n.a IS NULL THEN [m.seq]
      ELSE [n.seq, m.seq] END AS path FROM c LEFT JOIN m ON m.a = c.release_id LEFT JOIN m n ON n.a = m.b)
    SELECT root AS release_id, source_id, value, arg_min(location, (path, seq, location)) AS location, arg_min(seq, (path, seq, location)) AS seq FROM x GROUP BY ALL""",
)
def merged_claims(releases, assets):
    return snapshots.merged(releases, _claims(assets), _merges(releases))[1].select("release_id", "source_id", "value", "location", "seq")


@_query(
    "release_editions",
    "assets",
    sql=""", m AS (SELECT id AS a, id - 1 AS b FROM release_editions WHERE id % 3 = 0), h AS (SELECT DISTINCT release_id, source_id FROM assets WHERE k1 % 97 = 0)
    SELECT a AS from_id, b AS into_id, CASE WHEN EXISTS (SELECT 1 FROM h x JOIN h y USING (source_id) WHERE x.release_id = a AND y.release_id = b) THEN 'not_a_candidate'
      WHEN EXISTS (SELECT 1 FROM assets WHERE release_id = a AND k2 = 7) THEN 'edition_holds_assets' ELSE 'decided' END AS outcome FROM m""",
)
def merge_guards(releases, assets):
    merges = releases.where("id % 3 = 0").select(F.col("id").alias("from_id"), (F.col("id") - 1).alias("into_id"), F.col("id").alias("seq"))
    held = assets.where("k1 % 97 = 0").select("release_id", "source_id", F.lit("identifier").alias("field"), F.lit("source_record").alias("qualifier"))
    return snapshots.merge_outcomes(merges, held, assets.where("k2 = 7")).drop("seq")


_PART = "':' || octet_length(encode({0}))::VARCHAR || ':' || {0}"
_DESCRIBED = " || ".join(_PART.format(p) for p in ("source_id", "lower(trim(platform))", "lower(trim(title))", "lower(trim(region))", "lower(trim(edition))", "asset_type", "lower(trim(coalesce(label, original_filename)))", "url"))
_BY_ID = " || ".join(_PART.format(p) for p in ("source_id", "provider_id", "asset_type"))


@_query(
    "release_editions",
    "assets",
    sql=f""", c AS (SELECT a.*, title, platform, region, edition, CASE WHEN k1 % 3 = 0 THEN 'p' || k1 WHEN k1 % 3 = 1 THEN ' ' END AS provider_id,
      CASE WHEN k2 % 2 = 0 THEN ' Ünï ' END AS label, 'https://e.org/' || k1 AS url FROM assets a JOIN release_editions r ON r.id = a.release_id)
    SELECT identity, count(*) AS candidates FROM (SELECT 'candidate' || CASE WHEN trim(coalesce(provider_id, '')) <> '' THEN {_BY_ID} ELSE {_DESCRIBED} END AS identity FROM c) GROUP BY identity""",
)
def candidate_identities(releases, assets):
    rows = assets.join(releases, F.col("release_id") == F.col("id"))
    provider = F.when(F.col("k1") % 3 == 0, F.concat(F.lit("p"), F.col("k1").cast("string"))).when(F.col("k1") % 3 == 1, " ")
    label, url = F.when(F.col("k2") % 2 == 0, " Ünï "), F.concat(F.lit("https://e.org/"), F.col("k1").cast("string"))
    key = text.candidate_identity(F.col("source_id"), provider, *[F.col(c) for c in ("asset_type", "platform", "title", "region", "edition")], label, F.col("original_filename"), url)
    return rows.groupBy(key.alias("identity")).agg(F.count("*").alias("candidates"))


@_query(
    "release_editions",
    "assets",
    sql=""", a AS (SELECT k1 * 100000 + k2 * 10000 + k3 AS asset_id, release_id, asset_type, object_hash, byte_len, source_id, '/in/' || (k1 % 3) || '/' || k3 AS place FROM assets),
    q AS (SELECT asset_id AS record_id, a.*, r.game_id, title, platform, region, edition, asset_id % 3 AS kind FROM a JOIN release_editions r ON r.id = release_id WHERE asset_id % 5 = 0)
    SELECT q.record_id, min((a.asset_id, a.release_id, r.game_id))[1] AS asset_id, min((a.asset_id, a.release_id, r.game_id))[2] AS release_id FROM q
      JOIN a USING (source_id, asset_type, object_hash, byte_len, place)
      JOIN release_editions r ON r.id = a.release_id AND lower(r.title) = lower(q.title) AND r.platform = q.platform AND r.region = q.region AND r.edition = q.edition
    WHERE (kind = 0 OR r.game_id = q.game_id + (kind - 1)) AND (kind <> 1 OR a.release_id = q.release_id) GROUP BY q.record_id""",
)
def duplicate_imports(releases, assets):
    place = F.concat(F.lit("/in/"), (F.col("k1") % 3).cast("string"), F.lit("/"), F.col("k3").cast("string"))
    rows = assets.withColumns({"asset_id": F.col("k1") * 100_000 + F.col("k2") * 10_000 + F.col("k3"), "location": place})
    kind = F.col("asset_id") % 3
    asked = rows.where("asset_id % 5 = 0").join(releases, F.col("release_id") == F.col("id")).withColumn("record_id", F.col("asset_id"))
    asked = asked.withColumns({"location": F.regexp_replace("location", "^/in/", "/in//x/../"), "title": F.concat(F.lit(" "), F.upper("title")), "game_id": F.when(kind > 0, F.col("game_id") + kind - 1), "release_id": F.when(kind == 1, F.col("release_id"))})
    return linking.existing_imports(asked, rows.select("asset_id", "source_id", "location"), rows.select("asset_id", "release_id", "asset_type", "object_hash", "byte_len"), releases).select("record_id", "asset_id", "release_id")


@_query(
    "work",
    sql=""", o AS (SELECT source_id, work_id, row_number() OVER (PARTITION BY source_id ORDER BY work_id) AS age FROM work WHERE state = 'queued' AND source_id <> 'src3'),
    a AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY work_id) - 1 AS turn FROM o WHERE age <= 20 AND source_id <> 'src5' AND work_id % 4 <> 0)
    SELECT source_id, work_id, turn, row_number() OVER (ORDER BY turn, work_id) AS place FROM a WHERE turn < 5 AND work_id % 4 <> 3""",
)
def prefetch_order(work):
    queue = work.where("state = 'queued'").select("source_id", "work_id", (F.col("source_id") != "src5").alias("enabled"), F.expr("work_id % 4 in (1, 2)").alias("importable"), F.expr("work_id % 4 = 3").alias("begun"))
    return runs.prefetch(queue, 5, ["src3"])


_FOLDERS = {"box_front": "Named_Boxarts", "title_screen": "Named_Titles", "gameplay_screenshot": "Named_Snaps"}


@_query(
    "release_editions",
    sql=r""", w AS (SELECT DISTINCT platform, title, regexp_replace(title, '[&*/:"<>?\\|`]', '_', 'g') || '.png' AS file_name FROM release_editions),
    f(asset_type, folder) AS (VALUES ('box_front', 'Named_Boxarts'), ('title_screen', 'Named_Titles'), ('gameplay_screenshot', 'Named_Snaps')),
    l AS (SELECT DISTINCT platform, folder, title || '.png' AS file_name FROM release_editions, f
      WHERE folder <> 'Named_Snaps' AND (id % 3 = 0 OR platform = 'MAME') AND NOT (platform = 'MAME' AND folder = 'Named_Titles'))
    SELECT platform || '.git/' || folder || '/' || title AS candidate_id, platform, title, asset_type, folder, file_name FROM w, f
    WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.platform = w.platform AND l.folder = f.folder) OR EXISTS (SELECT 1 FROM l
      WHERE l.platform = w.platform AND l.folder = f.folder AND l.file_name = w.file_name)""",
)
def thumbnail_candidates(releases):
    folder = F.explode(F.array(F.lit("Named_Boxarts"), F.lit("Named_Titles")))
    listed = releases.where("id % 3 = 0 or platform = 'MAME'").select("platform", "title", folder.alias("folder")).where("not (platform = 'MAME' and folder = 'Named_Titles')")
    listings = listed.groupBy("platform", "folder").agg(F.collect_set(F.concat("title", F.lit(".png"))).alias("files"))
    repositories = releases.select("platform", F.concat("platform", F.lit(".git")).alias("repository")).distinct()
    return planning.thumbnails(releases, repositories, listings, _FOLDERS)


def _addresses(spark, sf_dir):
    """The addresses of pages as objects."""
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.coalesce("html", F.lit("")).cast("binary").alias("content"))
    return rows.select("page_id", blake3("content").alias("blake3"), F.sha2("content", 256).alias("sha256"))


_QUERIES["object_addresses"] = _addresses


@_query(
    "release_editions",
    "assets",
    "assertions",
    sql=""", a AS (SELECT release_id, k1 * 100000 + k2 * 10000 + k3 AS asset_id, asset_type, object_hash, source_id FROM assets),
    p AS (SELECT asset_id, string_agg(source_id || '@' || n, ';' ORDER BY n) AS told, count(*) AS n
      FROM (SELECT asset_id, source_id, unnest([1, 2][:1 + (asset_id % 2)::INT]) AS n FROM a WHERE asset_id % 3 <> 0) GROUP BY asset_id),
    d AS (SELECT object_hash, string_agg(DISTINCT asset_type, ';' ORDER BY asset_type) AS made FROM a WHERE asset_id % 5 = 0 GROUP BY object_hash),
    h AS (SELECT release_id, string_agg(a.asset_id || ':' || asset_type || ':' || coalesce(told, '') || ':' || coalesce(made, ''), '|'
      ORDER BY a.asset_id, asset_type, a.object_hash) AS held FROM a LEFT JOIN p USING (asset_id) LEFT JOIN d ON d.object_hash = a.object_hash
      GROUP BY release_id),
    c AS (SELECT release_id, string_agg(source_id || '=' || value, '|' ORDER BY k1, k2, k3, source_id, value) AS said FROM assertions GROUP BY release_id)
    SELECT id, title, coalesce(held, '') AS assets, coalesce(said, '') AS claims FROM release_editions r LEFT JOIN h ON h.release_id = id LEFT
      JOIN c ON c.release_id = id WHERE EXISTS (SELECT 1 FROM assets x WHERE x.release_id = r.id AND x.k2 = 2)""",
)
def whole_entries(releases, assets, assertions):
    rows = assets.select("release_id", (F.col("k1") * 100_000 + F.col("k2") * 10_000 + F.col("k3")).alias("asset_id"), "asset_type", "object_hash", "source_id")
    at = F.explode(F.when(F.col("asset_id") % 2 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    provenance = rows.where("asset_id % 3 <> 0").select("asset_id", "source_id", at.alias("at"), F.lit("l").alias("location"))
    derived = rows.where("asset_id % 5 = 0").select("object_hash", F.col("asset_type").alias("recipe"), F.lit("o").alias("output")).distinct()
    said = assertions.select("release_id", F.struct("k1", "k2", "k3").alias("at"), "source_id", F.lit("title").alias("field"), "value")
    found = library.whole_entries(releases, rows.drop("source_id"), provenance, said, derived, assets.where("k2 = 2").select(F.col("release_id").alias("id")))
    told = lambda p: F.concat(p["source_id"], F.lit("@"), p["at"].cast("string"))
    one = lambda a: F.concat_ws(":", a["asset_id"].cast("string"), a["asset_type"], F.array_join(F.transform(a["provenance"], told), ";"), F.array_join(F.transform(a["derived"], lambda d: d["recipe"]), ";"))
    return found.select("id", "title", F.array_join(F.transform("assets", one), "|").alias("assets"), F.array_join(F.transform("claims", lambda c: F.concat(c["source_id"], F.lit("="), c["value"])), "|").alias("claims"))


@_query(
    "release_editions",
    sql=""", c AS (SELECT id AS release_id, n, CASE WHEN (id + n) % 4 = 0 THEN 'other' ELSE 'df' || n END AS source_id,
      CASE WHEN (id + n) % 3 = 0 THEN octet_length(encode(platform)) || ':' || platform || title || ' (Rec ' || n || ')' WHEN (id + n) % 3 = 1 THEN 'x:' || platform
      ELSE '0:  ' END AS value FROM release_editions, (SELECT unnest([1, 2, 3]) AS n)),
    f AS (SELECT release_id, arg_min(n, n) AS n FROM c WHERE source_id <> 'other' AND (release_id + n) % 3 = 0 GROUP BY release_id)
    SELECT id, CASE WHEN n IS NOT NULL THEN title || ' (Rec ' || n || ')' ELSE title || CASE WHEN lower(region) = 'unknown' THEN ''
      ELSE ' (' || region || ')' END || CASE WHEN lower(edition) = 'standard' THEN '' ELSE ' (' || edition || ')' END END AS name
    FROM release_editions LEFT JOIN f ON release_id = id""",
)
def release_names(releases):
    rows = releases.withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    turn, name = (F.col("id") + F.col("n")) % 3, F.concat("title", F.lit(" (Rec "), F.col("n").cast("string"), F.lit(")"))
    value = F.when(turn == 0, text.source_record(F.col("platform"), name)).when(turn == 1, F.concat(F.lit("x:"), "platform")).otherwise("0:  ")
    source = F.when((F.col("id") + F.col("n")) % 4 == 0, "other").otherwise(F.concat(F.lit("df"), F.col("n").cast("string")))
    said = rows.select(F.col("id").alias("release_id"), F.col("n").alias("seq"), source.alias("source_id"), F.lit("identifier").alias("field"), F.lit("source_record").alias("qualifier"), value.alias("value"))
    return library.release_names(releases, said, ["df1", "df2", "df3"])


@_query(
    "assertions",
    sql=""", own AS (SELECT release_id, source_id, arg_max(value, (k1, k2, k3, value)) AS value, max((k1, k2, k3)) AS seen FROM assertions GROUP BY ALL),
    v AS (SELECT *, lower(regexp_replace(value, '\\s', '', 'g')) AS key FROM own),
    g AS (SELECT release_id, key, count(*) AS n, min((v.seen, source_id)) AS first FROM v GROUP BY ALL),
    b AS (SELECT release_id, key AS best FROM g QUALIFY row_number() OVER (PARTITION BY release_id ORDER BY n DESC, first) = 1)
    SELECT release_id, coalesce(string_agg(source_id, ','
      ORDER BY source_id) FILTER (WHERE key = best), '') AS contributing, coalesce(string_agg(source_id || '=' || trim(value), ','
      ORDER BY source_id) FILTER (WHERE key <> best), '') AS conflicting FROM v JOIN b USING (release_id) GROUP BY release_id""",
)
def judged_claims(assertions):
    found = claims.judged(assertions)
    return found.select("release_id", F.array_join(F.transform("contributing", lambda x: x["source_id"]), ",").alias("contributing"), F.array_join(F.transform("conflicting", lambda x: F.concat(x["source_id"], F.lit("="), x["value"])), ",").alias("conflicting"))


@_query(
    "assets",
    sql=""", f AS (SELECT DISTINCT CASE WHEN k2 <= 4 THEN 'derived' ELSE 'original' END AS area, object_hash,
      CASE k2 WHEN 1 THEN 'missing' WHEN 2 THEN 'corrupt' WHEN 3 THEN 'orphaned' WHEN 4 THEN 'unreadable' ELSE 'unreferenced' END AS state FROM assets
      WHERE k1 % 7 = 0 AND k2 <= 5),
    d AS (SELECT DISTINCT object_hash AS output, asset_type AS recipe, [object_hash, md5(object_hash)] AS originals FROM assets
      WHERE k1 % 5 = 0), r AS (SELECT DISTINCT object_hash FROM assets WHERE k1 % 3 = 0 UNION SELECT DISTINCT md5(object_hash) FROM assets WHERE k1 % 2 = 0)
    SELECT 'forget' AS action, output AS object_hash, recipe FROM d WHERE output IN (SELECT object_hash FROM f
      WHERE area = 'derived' AND state IN ('missing', 'corrupt')) OR output NOT IN (SELECT object_hash FROM r) OR md5(output) NOT IN (SELECT object_hash
      FROM r)
    UNION SELECT 'remove_derived', object_hash, NULL FROM f
      WHERE area = 'derived' AND state IN ('corrupt', 'orphaned') AND object_hash NOT IN (SELECT object_hash FROM f
      WHERE area = 'derived' AND state = 'unreadable')
    UNION SELECT 'collect_original', object_hash, NULL FROM f WHERE area = 'original'""",
)
def vault_repairs(assets):
    area = F.when(F.col("k2") <= 4, "derived").otherwise("original")
    state = F.element_at(F.array(*[F.lit(s) for s in ("missing", "corrupt", "orphaned", "unreadable", "unreferenced")]), F.col("k2").cast("int"))
    found = assets.where("k1 % 7 = 0 and k2 <= 5").select(area.alias("area"), "object_hash", state.alias("state")).distinct()
    derivatives = assets.where("k1 % 5 = 0").select(F.col("object_hash").alias("output"), F.col("asset_type").alias("recipe"), F.array("object_hash", F.md5("object_hash")).alias("originals")).distinct()
    referenced = assets.where("k1 % 3 = 0").select("object_hash").unionByName(assets.where("k1 % 2 = 0").select(F.md5("object_hash").alias("object_hash")))
    return vault.repairs(found, derivatives, referenced, True, True, True)


@_query(
    "assets",
    sql=""", b AS (SELECT DISTINCT release_id, object_hash AS front, 'packaging-model-' || asset_type || '-' || md5(object_hash) || '-s' AS recipe
      FROM assets WHERE k1 % 3 = 0), m AS (SELECT DISTINCT object_hash, asset_type FROM assets WHERE k1 % 11 = 0)
    SELECT release_id, front AS front_hash, recipe, CASE WHEN EXISTS (SELECT 1 FROM m
      WHERE object_hash = front AND 'packaging-model-' || asset_type || '-' || md5(object_hash) || '-s' = recipe) OR release_id > min(release_id) OVER (PARTITION BY front, recipe) THEN 'up_to_date'
      ELSE 'built' END AS state FROM b""",
)
def packaging_models(assets):
    keyed = assets.withColumn("recipe", vault.recipe_key(F.col("asset_type"), F.md5("object_hash"), F.lit("s")))
    bases = keyed.where("k1 % 3 = 0").select("release_id", F.col("object_hash").alias("front_hash"), "recipe").distinct()
    return vault.models_to_build(bases, keyed.where("k1 % 11 = 0").select("object_hash", "recipe"))


@_query("work", sql=""" SELECT run_id, bool_and(state = 'done') AS all_discovered FROM (SELECT run_id, source_id, max(CASE WHEN state = 'done' THEN 'done'
      ELSE '' END) AS state FROM work GROUP BY ALL) GROUP BY run_id""")
def discovered_runs(work):
    return runs.all_discovered(work, work.where("state = 'done'"))


@_query("work", sql=" SELECT run_id, source_id FROM work WHERE state = 'done' UNION SELECT run_id, source_id FROM work WHERE state = 'parked'")
def sources_with_work(work):
    return runs.known_sources(work.where("state = 'done'"), work.where("state = 'parked'"))
