"""How much work plans do on tables whose keys are hot: rows that joins make, what is shuffled, what is kept."""

from lodestack.functions.text import digest
from lodestack.operators import importing, library, linking, matching, reference, rounds, runs
from lodestack.operators.ranks import ranked
from lodestack.plans import registry, workflow  # noqa: F401  (it registers its queries)
from lodestack.plans.bridge import relation
from pyspark.sql import functions as F


def nodes(plan):
    """All nodes of a plan that has run, with those of its stages."""
    name = plan.getClass().getSimpleName()
    inner = plan.executedPlan() if name == "AdaptiveSparkPlanExec" else plan.plan() if name.endswith("QueryStageExec") else None
    below = [inner] if inner is not None else [plan.children().apply(i) for i in range(plan.children().size())]
    return [(name, plan), *[x for b in below for x in nodes(b)]]


def ran(df):
    """The rows of a table, and the nodes by which they came."""
    rows = df.collect()
    return rows, nodes(df._jdf.queryExecution().executedPlan())


def most(found, kind=""):
    """The most rows that a node of this kind gave."""
    counts = [p.metrics().apply("numOutputRows").value() for name, p in found if kind in name and p.metrics().contains("numOutputRows")]
    return max(counts, default=0)


def test_only_pairs_of_the_best_score_are_gathered(spark):
    regions = ["USA", "Europe", "Japan", "World", "Germany"]
    releases = spark.range(500).select("id", F.lit(1).cast("long").alias("game_id"), F.lit("T").alias("title"), F.lit("P").alias("platform"), F.get(F.array(*[F.lit(r) for r in regions]), (F.col("id") % 5).cast("int")).alias("region"), F.concat(F.lit("e"), F.col("id").cast("string")).alias("edition"))
    candidates = releases.where("id < 100").select(F.col("id").alias("candidate_id"), "title", "platform", "region", "edition")
    c, r = matching.candidate_signatures(candidates), matching.release_signatures(releases)
    best = matching._all(matching.scored(c.withColumn("c_points", F.lit(100)), r))
    assert best.count() == 100
    assert {(x["release_id"] - x["candidate_id"], x["score"], x["confidence"]) for x in matching.matched(candidates, releases).collect()} == {(0, 100, "high")}


def test_games_meet_what_records_say_once(spark):
    n = 400
    known = spark.range(n).select("id", F.lit(7).cast("long").alias("game_id"), F.lit("P").alias("platform"), F.lit("USA").alias("region"), F.lit("Standard").alias("edition"))
    titled = spark.range(n).select(F.col("id").alias("release_id"), F.lit("s1").alias("source_id"), F.lit("T").alias("title"))
    records = spark.range(n).select((F.col("id") + n).alias("record_id"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_id"), F.lit(" t").alias("title"), F.lit("p").alias("platform"), F.when(F.col("id") % 4 > 1, "Japan").alias("region"), F.lit("x").alias("edition"))
    rows, found = ran(reference.games_for_new_editions(records, known, titled, titled.select("release_id", "source_id")))
    assert len(rows) == n and {r["game_id"] for r in rows} == {7}  # a region that is missing, too
    assert most(found) <= 4 * n
    same = records.withColumns({"region": F.lit("usa"), "edition": F.lit("standard")})
    rows, _ = ran(reference.games_for_new_editions(same, known, titled, titled.select("release_id", "source_id")))
    assert {(r["record_id"] % 2, r["game_id"]) for r in rows} == {(0, None), (1, 7)}


def test_pairs_of_editions_are_made_once_and_not_kept(spark):
    n = 80
    editions = spark.range(n).select("id", F.lit(0).cast("long").alias("game_id"))
    held = spark.range(n).select(F.col("id").alias("release_id"), F.explode(F.array(F.lit("s1"), F.lit("s2"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string")))).alias("source_id"))
    rows, found = ran(reference.sharing_a_source(editions, held.unionByName(held)))
    assert sorted((r["a"], r["b"]) for r in rows) == [(a, b) for a in range(n) for b in range(a + 1, n)]
    assert most(found, "Aggregate") <= 6 * n


def test_editions_that_share_a_source_are_found_in_all_assets(spark, sf):
    held, game = {}, {r["id"]: r["game_id"] for r in relation(spark, sf, "release_editions").collect()}
    for r in relation(spark, sf, "assets").select("release_id", "source_id").distinct().collect():
        held.setdefault(r["release_id"], set()).add(r["source_id"])
    want = {(a, b) for a in held for b in held if a < b and game[a] == game[b] and held[a] & held[b]}
    rows = sorted((r["a"], r["b"]) for r in registry.queries()["editions_sharing_a_source"](spark, sf).collect())
    assert rows == sorted(want) and len(want) > 200


def test_editions_of_like_sources_meet_as_sets(spark):
    n = 200
    editions = spark.range(n).select("id", F.lit(0).cast("long").alias("game_id"))
    held = spark.range(n).select(F.col("id").alias("release_id"), F.explode(F.array(*[F.concat(F.lit("s"), ((F.col("id") % 2) * 9 + k).cast("string")) for k in range(9)])).alias("source_id"))
    rows, found = ran(reference.sharing_a_source(editions, held))
    assert sorted((r["a"], r["b"]) for r in rows) == [(a, b) for a in range(n) for b in range(a + 1, n) if (b - a) % 2 == 0]
    assert most(found, "Join") <= 9 * 2 * reference.SHARES**2  # shares of alike editions, not editions


def test_ranks_shuffle_rows_once(spark):
    rows = spark.range(2000).select((F.col("id") * 7919 % 2000).alias("k"), (F.col("id") % 3).alias("g"), F.lit("x").alias("wide"))
    got, found = ran(ranked(rows, ["g"], ["k"], "place", "total"))
    assert not [1 for name, _ in found if name == "ShuffleExchangeExec"]  # the shuffle by ranges is over, its result written
    places = {}
    for r in sorted(got, key=lambda r: (r["g"], r["k"])):
        places[r["g"]] = places.get(r["g"], 0) + 1
        assert r["place"] == places[r["g"]]
    assert {r["total"] for r in got} == set(places.values())


def test_known_imports_meet_by_digests(spark):
    names = [F.lit(x).alias(c) for c, x in (("title", "T"), ("platform", "P"), ("region", "USA"), ("edition", "Standard"))]
    editions = spark.range(10).select("id", F.lit(5).cast("long").alias("game_id"), *names)
    assets = spark.range(200).select(F.col("id").alias("asset_id"), (F.col("id") % 10).alias("release_id"), F.lit("manual").alias("asset_type"), F.col("id").cast("string").alias("object_hash"), F.lit(3).cast("long").alias("byte_len"))
    provenance = assets.select("asset_id", F.lit("s").alias("source_id"), F.lit("/a/b").alias("location"))
    asked = assets.select(F.col("asset_id").alias("record_id"), "asset_type", "object_hash", "byte_len", F.lit("s").alias("source_id"), F.lit("/a//x/../b").alias("location"), F.lit(None).cast("long").alias("game_id"), F.when(F.col("asset_id") < 50, F.col("release_id")).when(F.col("asset_id") < 100, 77).alias("release_id"), *names)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows, found = ran(linking.existing_imports(asked, provenance, assets, editions))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(tuple(r) for r in rows) == [(k, k, k % 10, 5) for k in range(200) if not 50 <= k < 100]
    kinds = {p.output().apply(i).dataType().simpleString() for name, p in found if name == "ShuffleExchangeExec" for i in range(p.output().size())}
    assert kinds and "string" not in kinds
    pairs = spark.createDataFrame([("a", "b:c"), ("a:b", "c"), ("1", ""), ("", "1"), (None, "1")], "x string, y string").select(digest(F.col("x"), F.col("y")).alias("d")).collect()
    assert len({bytes(r["d"]) for r in pairs if r["d"] is not None}) == 4 and pairs[4]["d"] is None


def test_exported_rows_are_not_written_to_be_counted(spark, monkeypatch):
    releases = spark.range(30).select("id", F.lit("P").alias("platform"), F.concat(F.lit("T"), (F.col("id") % 15).cast("string")).alias("title"), F.lit("USA").alias("region"), F.lit("Standard").alias("edition"))
    assets = spark.range(900).select((F.col("id") % 30).alias("release_id"), F.lit("manual").alias("asset_type"), F.md5(F.col("id").cast("string").cast("binary")).alias("object_hash"), F.lit(1).cast("long").alias("byte_len"), F.concat(F.when(F.col("id") % 2 == 0, "A").otherwise("a"), F.when(F.col("id") < 30, "1").otherwise("2"), F.lit(".png")).alias("original_filename"), F.lit("image/png").alias("media_type"))
    kept, write = [], library.written
    monkeypatch.setattr(library, "written", lambda df, name: kept.append(out := write(df, name)) or out)
    rows = library.export_paths(releases, assets).collect()
    assert sum(t.count() for t in kept) <= 4
    assert len(rows) == 900 and len({r["path"].lower() for r in rows}) == 900 and all("(" in r["path"].rsplit("/", 1)[1] for r in rows)


def _of_one_title(spark, n, key):
    one = spark.range(n).select("id", F.lit(1).cast("long").alias("game_id"), F.lit("T").alias("title"), F.lit("P").alias("platform"), F.lit("USA").alias("region"), F.concat(F.lit("e"), (F.col("id") % 100).cast("string")).alias("edition"))
    return one.withColumnRenamed("id", key)


def test_lists_are_not_shuffled(spark, monkeypatch):
    candidates, releases = _of_one_title(spark, 300, "candidate_id"), _of_one_title(spark, 400, "id")
    rows, found = ran(matching.competing_lists(candidates, releases))
    usual = sorted(map(tuple, rows))
    assert [x[0] for x in usual] == list(range(300)) and {len(x[1]) for x in usual} == {400}
    assert [(m["release_id"], m["score"], m["e_edition"]) for m in usual[7][1]][:5] == [(7, 100, 5), (107, 100, 5), (207, 100, 5), (307, 100, 5), (0, 90, -5)]
    sizes = [p.metrics().apply("dataSize").value() for name, p in found if name == "ShuffleExchangeExec"]
    assert sizes and sum(sizes) < 200_000  # the lists are 120,000 rows
    assert not [name for name, _ in found if name == "BroadcastExchangeExec"]
    monkeypatch.setattr(matching, "CHUNK", 1)
    assert sorted(map(tuple, matching.competing_lists(candidates, releases).collect())) == usual


def test_lists_make_no_row_for_a_pair(spark):
    candidates, releases = _of_one_title(spark, 300, "candidate_id"), _of_one_title(spark, 400, "id")
    rows, found = ran(matching.competing_lists(candidates, releases))
    assert len(rows) == 300 and {len(x[1]) for x in rows} == {400}
    assert most(found, "Join") <= 100  # a row for each signature; pairs of signatures are 10,000


def test_lists_hold_what_scores_without_a_title(spark):
    c = spark.createDataFrame([(1, "T", "P", "USA", "x"), (2, "", "P", "USA", "x"), (3, "U", "P", "USA", "x")], "candidate_id long, title string, platform string, region string, edition string")
    r = spark.createDataFrame([(11, 1, "T", "P", "USA", "x"), (12, 2, None, "P", "USA", "x"), (13, 3, "T", "", "Japan", "x")], "id long, game_id long, title string, platform string, region string, edition string")
    got = {x["candidate_id"]: [(m["release_id"], m["score"]) for m in x["matches"]] for x in matching.competing_lists(c, r, 30).collect()}
    assert got == {1: [(11, 100), (12, 50), (13, 40)], 2: [(11, 50), (12, 50)], 3: [(12, 50)]}
    assert {x["release_id"]: x["items"] for x in matching.competing_releases(c, r, 30).collect()} == {11: 2, 12: 3, 13: 1}


def test_no_signatures_go_through_the_driver(spark):
    """Signatures of candidates and releases, the ids of open work: all grow, and none is broadcast."""
    candidates, releases = _of_one_title(spark, 300, "candidate_id"), _of_one_title(spark, 400, "id")
    work = spark.range(300).select(F.col("id").alias("work_id"), F.lit("pending").alias("review_status"))
    rows, found = ran(matching.competing_releases(runs.undecided_candidates(candidates, work), releases))
    assert {x["items"] for x in rows} == {300} and len(rows) == 400
    assert not [name for name, _ in found if name == "BroadcastExchangeExec"]


def test_rounds_of_an_import_make_no_pairs_of_records(spark, monkeypatch):
    """Records of two sources with one dump set and titles of their own: whether one edition has it is told by a few of them."""
    n, made, write = 120, [], rounds.written

    def counted(df, name):
        made.append((name, most(ran(df)[1], "Join")))
        return write(df, name)

    monkeypatch.setattr(rounds, "written", counted)
    title = F.concat(F.lit("T"), F.col("id").cast("string"))
    records = spark.range(n).select((F.col("id") + 1000).alias("seq"), F.concat(F.lit("s"), (F.col("id") % 2).cast("string")).alias("source_id"), title.alias("record_id"), F.lit("f").alias("location"), title.alias("title"), *[F.lit(x).alias(c) for c, x in (("platform", "GB"), ("region", "USA"), ("edition", "Standard"), ("dump_set", "a"))])
    nothing = [spark.createDataFrame([], s) for s in ("id long, game_id long, platform string, region string, edition string", "release_id long, source_id string, location string, field string, qualifier string, value string, seq long", "source_id string, record_id string, release_id long, dump_set string")]
    rows = importing.imported(*nothing, records).select("seq", "release_id", "outcome").collect()
    assert {r["seq"]: (r["release_id"], r["outcome"]) for r in rows} == {1000: (1000, "founded"), 1001: (1000, "linked")} | {1000 + k: (1000 + k, "founded") for k in range(2, n)}
    assert {name for name, _ in made} == {"placed"} and max(k for _, k in made) <= 8 * n
