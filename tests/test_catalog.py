import os
import re

import duckdb
import pytest
from lodestack.functions import text
from lodestack.operators import claims, coverage, library, linking, matching, preference, vault
from lodestack.plans import changes, details, registry, workflow  # noqa: F401  (they register their queries)
from lodestack.sources import datafiles, html, objects
from lodestack.streaming import queue
from pyspark.sql import functions as F

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    return f"{float(value):.6g}" if isinstance(value, float) or hasattr(value, "quantize") else str(value)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    cur = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    expected = sorted(tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()) == expected


def assets(spark, rows):
    return spark.createDataFrame(rows, "release_id long, asset_type string, k1 long, k2 int, k3 long, object_hash string, byte_len long, width long, height long")


def test_preference_and_reasons(spark):
    df = assets(spark, [(1, "box_front", 1, 1, 1, "a", 7_000, 30, 40), (1, "box_front", 2, 1, 1, "b", 9_000, 50, 70), (1, "box_front", 3, 1, 1, "c", 20_000, None, 5)])
    assert [r["object_hash"] for r in preference.preferred(df).collect()] == ["b"]
    got = {r["k1"]: (r["reason"], r["other"]) for r in preference.reasons(df).collect()}
    assert got == {1: ("more_pixels", 1_200), 3: ("more_pixels", None)}
    same = assets(spark, [(1, "disc", k, 1, 1, str(k), b, 10, 10) for k, b in ((1, 31), (2, 77), (3, 31))])
    assert {r["k1"]: r["reason"] for r in preference.reasons(same).collect()} == {1: "more_bytes", 3: "more_bytes"}
    assert preference.preferred(same).collect()[0]["k1"] == 2
    new = assets(spark, [(1, "disc", 9, 1, 1, "new", 60, 10, 10), (1, "disc", 10, 1, 1, "2", 1, 1, 1)])
    assert [(r["new_k1"], r["outranker"]) for r in preference.outranked(same, new, 1).collect()] == [(9, "2")]
    assert preference.outranked(same, new, 2).count() == 0
    assert preference.preferred(df.limit(0)).count() == 0


def test_canonical_values(spark):
    rows = [(1, "a", "Old", 1), (1, "a", "The  Game", 5), (1, "b", "the game", 3), (1, "c", "Other", 2), (2, "a", "X", 1), (2, "b", "Y", 2)]
    df = spark.createDataFrame([(r, s, v, k, 1, 1) for r, s, v, k in rows], "release_id long, source_id string, value string, k1 long, k2 int, k3 long")
    got = {r["release_id"]: (r["value"], r["confidence"]) for r in claims.canonical(df).collect()}
    assert got == {1: ("the game", 66), 2: ("X", 50)}


def test_coverage_needs_every_earlier_profile(spark):
    releases = spark.createDataFrame([(1, " nintendo - GAME BOY"), (2, "MAME"), (3, "Game Boy"), (4, "Anything (Digital)"), (5, "Anything (digital)"), (6, "Sony - PlayStation 2")], "id long, platform string")
    rows = [(1, t) for t in ("box_front", "box_back", "spine", "cartridge_front", "manual")] + [(2, "pcb")] + [(4, t) for t in ("box_front", "logo", "icon")] + [(6, "disc")]
    have = spark.createDataFrame(rows, "release_id long, asset_type string")
    got = {r["id"]: r["status"] for r in coverage.status(releases, have).collect()}
    assert got == {1: "physical", 2: "none", 3: None, 4: "archival", 5: None, 6: "none"}
    asked = {(r["id"], r["profile"]): (r["required"], r["missing"]) for r in coverage.by_profile(releases, have).collect()}
    assert asked[1, "physical"] == (5, 0) and asked[1, "archival"] == (6, 1) and asked[6, "physical"] == (4, 3) and asked[4, "archival"] == (3, 0)
    assert (4, "physical") not in asked


def test_matching_rules(spark):
    c = spark.createDataFrame(
        [(1, "Quest", "Game Boy", "USA", "Standard"), (2, "Quest", "Game Boy", "Japan", "Standard"), (3, "Quest", "Other", "USA", "Standard"), (4, "Quest", "Game Boy", "Unknown", "Unspecified"), (5, "Twin", "MAME", "USA", "Standard"), (6, "", "MAME", "USA", "Deluxe"), (7, "None", "x", "USA", "y")],
        "candidate_id long, title string, platform string, region string, edition string",
    )
    r = spark.createDataFrame(
        [(10, 1, "quest ", "Game Boy", "USA", "Standard"), (11, 1, "Quest", "Game Boy", "Europe", "Deluxe"), (21, 2, "Twin", "MAME", "USA", "Standard"), (20, 3, "Twin", "MAME", "USA", "Standard"), (30, 4, "Solo", "MAME", "USA", "Deluxe")],
        "id long, game_id long, title string, platform string, region string, edition string",
    )
    got = {x["candidate_id"]: (x["release_id"], x["score"], x["confidence"]) for x in matching.best(c, r).collect()}
    assert got == {1: (10, 100, "high"), 2: (10, 70, "medium"), 4: (10, 80, "high"), 5: (20, 100, "medium"), 6: (30, 50, "medium")}
    marked = r.withColumn("preferred", F.col("id") == 11)
    low = {x["candidate_id"]: (x["release_id"], x["score"], x["confidence"]) for x in matching.matched(c, marked, 40, 20).collect()}
    assert low[3] == (10, 40, "medium") and low[4] == (11, 80, "high") and low[7][1:] == (0, "low")
    assert {x["release_id"]: x["items"] for x in matching.competing_releases(c, r).collect()} == {10: 3, 11: 3, 20: 1, 21: 1, 30: 1}
    assert matching.best(c.limit(0), r).count() == 0


def test_every_candidate_has_a_match(spark):
    c = spark.createDataFrame(
        [(1, "Quest", "Game Boy", "USA", "Standard"), (3, "Quest", "Other", "USA", "Standard"), (4, "Quest", "Other", "Japan", "Deluxe"), (6, "", "MAME", "Japan", "x"), (7, "None", "x", "USA", "y"), (8, None, None, "Europe", "Deluxe")],
        "candidate_id long, title string, platform string, region string, edition string",
    )
    r = spark.createDataFrame(
        [(9, 5, "Else", "NES", "Brazil", "Standard"), (10, 1, "quest ", "Game Boy", "USA", "Standard"), (30, 4, "Solo", "MAME", "Europe", "Deluxe")],
        "id long, game_id long, title string, platform string, region string, edition string",
    )
    rows = lambda c, r: {x["candidate_id"]: (x["release_id"], x["score"], x["confidence"]) for x in registry.match_every_candidate(c, r).collect()}
    assert rows(c, r) == {1: (10, 100, "high"), 3: (10, 40, "low"), 4: (9, 0, "low"), 6: (30, 10, "low"), 7: (9, 0, "low"), 8: (30, 20, "low")}
    assert set(rows(c, r.limit(0)).values()) == {(None, 0, "low")}
    one_game = spark.createDataFrame([(1, 1, "A", "P", "Japan", "Deluxe"), (2, 1, "A", "P", "USA", "Standard")], r.schema)
    assert rows(c.where("candidate_id = 7"), one_game) == {7: (2, 0, "low")}


def test_linking(spark):
    rec = spark.createDataFrame([(1, "s1", "A", "P", "R", "E", "d1"), (2, "s1", "A", "P", "R", "E", None), (3, "s1", "Z", "P", "R", "E", None)], "record_id long, source_id string, title string, platform string, region string, edition string, dump_set string")
    known = spark.createDataFrame([(10, "s2", "B", "p", "r", "e", "d1"), (11, "s2", "a ", "p", "r", "e", None), (12, "s3", "a", "p", "r", "e", None)], "release_id long, source_id string, title string, platform string, region string, edition string, dump_set string")
    got = {r["record_id"]: tuple(r)[1:] for r in linking.link(rec, known).collect()}
    assert got == {1: ("dumps", "linked", 10), 2: ("title", "uncertain", None), 3: ("none", "unlinked", None)}


def test_names(spark):
    rows = ["Quest (USA) (Rev 1) (Beta)", "A (B (C))", "Plain", "X (USA)(Rev 1)", ""]
    df = spark.createDataFrame([(x,) for x in rows], "n string")
    got = df.select(text.release_title(F.col("n")), text.release_tags(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("Quest", ["USA", "Rev 1", "Beta"]), ("A (B", ["C)"]), ("Plain", []), ("X", ["USA)(Rev 1"]), ("", [])]
    names = spark.createDataFrame([(x,) for x in ("a/b:c", " ..", "CON", "con.txt", "ok")], "n string").select(text.safe_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["a-b-c", "_", "_CON", "_con.txt", "ok"]
    odd = [".hack", " a\x85b. ", "e\u0301" * 3, "x" * 200 + ".png", "\u00e9" * 130 + ".jpeg", "Con .x"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in odd], "n string").select(text.safe_name(F.col("n"))).collect()]
    assert got == [".hack", "a-b", "\u00e9" * 3, "x" * 116 + ".png", "\u00e9" * 115 + ".jpeg", "_Con .x"]
    keys = spark.createDataFrame([("Legend of X, The - A Part",), ("The Legend  of X: a part",), ("Legend of X, The: Part, A",)], "n string")
    assert [r[0] for r in keys.select(text.title_key(F.col("n"))).distinct().collect()] == ["the legend of x: a part"]
    sequels = spark.createDataFrame([("Mega Thing II",), ("mega-thing 2",), ("Thing, The",), ("The Thing",)], "n string").select(text.sequel_key(F.col("n"))).collect()
    assert [r[0] for r in sequels] == ["megathing2", "megathing2", "thething", "thething"]
    filed = spark.createDataFrame([("The Legend of X: A Part",), ("Plain",), ("An X",)], "n string").select(text.filed_title(F.col("n"))).collect()
    assert [r[0] for r in filed] == ["Legend of X, The - A Part", "Plain", "X, An"]
    listed = spark.createDataFrame([("Some\u00a0Game - [ 3 Discs ]",), ("Other [x]",), ("Dash --",)], "n string").select(text.listed_title(F.col("n"))).collect()
    assert [r[0] for r in listed] == ["Some Game", "Other [x]", "Dash"]
    records = [("4:Pl\u00e9Name",), ("4:abcd ",), ("x:ab",), ("9:abc",)]
    assert [r[0] for r in spark.createDataFrame(records, "n string").select(text.recorded_name(F.col("n"))).collect()] == ["Name", None, None, None]


def test_pages_walk_all_rows(spark):
    rows = [(i, t, "p", "r", "e") for i, t in enumerate(["b", "A", "a", "c", "B"])]
    df = spark.createDataFrame(rows, "id long, title string, platform string, region string, edition string")
    seen, after = [], None
    while part := library.page(df, 2, after).collect():
        seen += [r["id"] for r in part]
        after = df.where(F.col("id") == seen[-1])
    assert seen == [1, 2, 0, 4, 3]


def test_vault(spark):
    d = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a")], "derived_hash string, object_hash string")
    ref = spark.createDataFrame([("a",)], "object_hash string")
    assert {r["derived_hash"]: r["in_use"] for r in vault.derived_in_use(d, ref).collect()} == {"x": False, "y": True}


XML = """<?xml version="1.0"?><datafile><header><name>Some Machine (Headered)</name><version>1</version></header>
<game name="One (USA)"><description>One</description><rom name="one.bin" size="4" crc="AB12" sha1="0000000000000000000000000000000000000012"/></game>
<game name=" "><description>nameless</description></game>
<game name="Two &amp; Three (USA, Europe)"><rom name="a.bin" crc="01"/><rom name="b.bin" md5="FF"/></game></datafile>"""


def test_xml_datafile(spark, tmp_path):
    (tmp_path / "a.dat").write_text(XML)
    games = datafiles.releases(spark, str(tmp_path / "a.dat"))
    assert sorted((r["name"], r["platform"]) for r in games.collect()) == [("One (USA)", "Some Machine"), ("Two & Three (USA, Europe)", "Some Machine")]
    assert datafiles.skipped(spark, str(tmp_path / "a.dat")).collect()[0]["skipped"] == 1
    ids = sorted((r["name"][:3], r["qualifier"], r["value"]) for r in datafiles.identifiers(games).collect())
    assert ids == [("One", "crc", "ab12"), ("One", "sha1", "0" * 38 + "12"), ("Two", "crc", "01"), ("Two", "md5", "ff")]
    assert datafiles.assertions(games, "s").where("field = 'title'").count() == 2


def test_game_list(spark, tmp_path):
    (tmp_path / "l.dat").write_text('header ( name "M" )\ngame ( name "A (USA)" rom ( name "a (1).bin" sha1 AA ) )\ngame ( name "A (USA)" rom ( name b sha1 BB ) )\ngame ( comment x )\n')
    got = [(r["name"], r["dumps"]) for r in datafiles.game_list(spark, str(tmp_path / "l.dat")).collect()]
    assert got == [("A (USA)", ["aa", "bb"])]
    (tmp_path / "bad.dat").write_text("game ( name x")
    with pytest.raises(Exception, match="inside a block"):
        datafiles.game_list(spark, str(tmp_path / "bad.dat")).collect()


def test_submodules(spark, tmp_path):
    (tmp_path / "m").write_text('[submodule "a"]\n\tpath = A\n\turl = https://x/a.git\n[submodule "b"]\n\tpath = B\n\turl = https://x/b.git\n\tbranch = main\n')
    assert sorted(tuple(r)[1:] for r in datafiles.submodules(spark, str(tmp_path / "m")).collect()) == [("A", "https://x/a.git", "master"), ("B", "https://x/b.git", "main")]


def test_listing_and_headings(spark):
    page = '<a href="?C=N">n</a><a href="/up/">up</a><a href="A%20B.png">x</a><a href="c+d.PNG">y</a><a href="dir/">z</a>'
    rows = html.listed_files(spark.createDataFrame([(1, page)], "page_id long, html string"), ["png"]).collect()
    assert [r["name"] for r in rows] == ["A B.png", "c+d.PNG"]
    cells = spark.createDataFrame([(1, 0, None, "x"), (1, 1, "G", None), (1, 2, None, "y")], "page_id long, pos int, heading string, href string")
    assert [(r["href"], r["belongs_to"]) for r in html.under_headings(cells).collect()] == [("y", "G")]


def test_object_store(spark, tmp_path):
    import hashlib

    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big")
    good = hashlib.sha256(png).hexdigest()
    for name, data in ((good, png), ("f" * 64, b"BM"), ("x", b"")):
        (tmp_path / name[:2] / name[2:4]).mkdir(parents=True, exist_ok=True)
        (tmp_path / name[:2] / name[2:4] / name).write_bytes(data)
    found = objects.stored(spark, str(tmp_path))
    assert {r["object_hash"]: r["state"] for r in objects.checked(found).collect()} == {good: "intact", "f" * 64: "corrupt"}
    w, h = objects.png_size(F.col("content"))
    row = found.where(F.col("object_hash") == good).select(objects.media_type(F.col("content")).alias("m"), w.alias("w"), h.alias("h")).first()
    assert tuple(row) == ("image/png", 640, 480)


def test_queue_stream(spark, tmp_path):
    src, out = tmp_path / "in", []
    events = [(1, "k", 1, "enqueue"), (1, "k", 2, "park"), (1, "k", 3, "enqueue"), (1, "z", 1, "finish")]
    spark.createDataFrame(events, "run_id long, work_key string, seq long, event string").write.parquet(str(src))
    stream = spark.readStream.schema("run_id long, work_key string, seq long, event string").parquet(str(src))

    def keep(df, _):
        out.extend(tuple(r) for r in df.collect())

    queue.states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    spark.createDataFrame([(1, "k", 4, "finish")], "run_id long, work_key string, seq long, event string").write.mode("append").parquet(str(src))
    queue.states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [(1, "k", "done", 3), (1, "k", "parked", 2), (1, "z", "", 0)]
    batch = spark.createDataFrame(events, "run_id long, work_key string, seq long, event string")
    assert queue.enqueue(batch).count() == 2


def test_entry(spark):
    import __spark_entry__

    assert os.path.exists("/root/testdata/sf0.001")
    assert __spark_entry__.entry(spark).count() > 0


def test_snapshots(spark):
    from lodestack.operators import snapshots

    key = "release_id long, asset_type string, object_hash string"
    old = spark.createDataFrame([(1, "disc", "a", 5)], f"{key}, seq long")
    by = spark.createDataFrame([(1, "disc", "a", "s", "l", "known")], f"{key}, source_id string, location string, details string")
    new = spark.createDataFrame([(1, "disc", "a", 9, "s", "l", None), (1, "disc", "a", 10, "t", "l", "x"), (2, "pcb", "b", 11, "s", "l", None)], f"{key}, seq long, source_id string, location string, details string")
    assets_now, by_now = snapshots.retained(old, by, new)
    assert sorted((r[2], r[3]) for r in assets_now.collect()) == [("a", 5), ("b", 11)]
    assert sorted((r["object_hash"], r["source_id"], r["details"]) for r in by_now.collect()) == [("a", "s", "known"), ("a", "t", "x"), ("b", "s", None)]
    merges = spark.createDataFrame([(2, 1, 0)], "from_id long, into_id long, seq long")
    claims_ = spark.createDataFrame([(1, "s", "l", "title", "", "v", 7), (2, "s", "l", "title", "", "v", 3)], "release_id long, source_id string, location string, field string, qualifier string, value string, seq long")
    left, moved = snapshots.merged(spark.createDataFrame([(1,), (2,)], "id long"), claims_, merges)
    assert [r["id"] for r in left.collect()] == [1] and [(r["release_id"], r["seq"]) for r in moved.collect()] == [(1, 7)]
    items = spark.createDataFrame([(1, [2, 3, 1]), (2, [])], "item_id long, candidates array<long>")
    assert {r["item_id"]: r["candidates"] for r in snapshots.renamed_candidates(items, merges).collect()} == {1: [3, 1], 2: []}
    d = spark.createDataFrame([("o", "r", "x")], "object_hash string, recipe string, output string")
    more = spark.createDataFrame([("o", "r", "w"), ("o", "q", "y")], d.schema)
    assert sorted(r["output"] for r in snapshots.recorded(d, more).collect()) == ["x", "y"]
    assert snapshots.forgotten(d, spark.createDataFrame([("x",)], "object_hash string")).count() == 0
    p = spark.createDataFrame([(1, "disc", "a", "i"), (2, "disc", "a", "i"), (2, "disc", "a", "j"), (3, "disc", "b", "i")], f"{key}, identity string")
    keep = spark.createDataFrame([("i", 1)], "identity string, kept_id long")
    prov, held = snapshots.detached(p, p.select("release_id", "asset_type", "object_hash").distinct(), p.where("identity = 'i'").select("identity"), keep)
    assert sorted((r[0], r[3]) for r in prov.collect()) == [(1, "i"), (2, "j")] and sorted(r[0] for r in held.collect()) == [1, 2]


def test_summaries_and_search(spark):
    from lodestack.operators import reference, search, summaries

    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "outcome string")
    assert tuple(summaries.by_outcome(rows, ["a", "b", "c"]).first()) == (2, 1, 0)
    names = spark.createDataFrame([("X (USA)",), ("Y (Europe, usa) (Beta)",)], "name string")
    assert summaries.carry_regions(names, ["USA"]).first()[0] and not summaries.carry_regions(names, ["Europe"]).first()[0]
    sources = spark.createDataFrame([("a", True, True, ["disc", "map"]), ("b", True, False, ["disc"]), ("c", True, True, ["pcb"]), ("d", False, True, ["disc"])], "source_id string, enabled boolean, direct boolean, asset_types array<string>")
    got = {r[0]: (r[1], r[2]) for r in summaries.capable(sources, ["disc"]).collect()}
    assert got["a"] == (["disc"], None) and got["b"][1].startswith("cannot") and got["c"][1].startswith("acquires") and got["d"][1] == "disabled"
    fields = spark.createDataFrame([("b", False, "missing"), ("c", True, "missing"), ("d", False, "unreadable")], "source_id string, optional boolean, state string")
    told = {r[0]: (r[1], r[2]) for r in summaries.described_sources(sources, fields, spark.createDataFrame([("a",)], "source_id string")).collect()}
    assert told == {"a": (False, "not_needed"), "b": (True, "missing"), "c": (True, "stored"), "d": (True, "unreadable")}
    w, h = summaries.fit_within(F.col("w"), F.col("h"), 100)
    sizes = spark.createDataFrame([(400, 200), (50, 20), (1000, 1)], "w int, h int").select(w, h).collect()
    assert [tuple(r) for r in sizes] == [(100, 50), (50, 20), (100, 1)]
    planned = spark.createDataFrame([(1, ["b", "a"])], "run_id long, sources array<string>")
    complete = spark.createDataFrame([(1, "a")], "run_id long, source_id string")
    at = summaries.discoveries(planned, complete, spark.createDataFrame([(1, "b", 20)], "run_id long, source_id string, games int"))
    assert [tuple(r)[2:] for r in at.orderBy("pos").collect()] == [("b", False, 20), ("a", True, 0)]
    firsts = summaries.first_seen(spark.createDataFrame([("B", 2), ("b", 1)], "x string, n int"), F.lower("x"), "n").collect()
    assert [tuple(r) for r in firsts] == [("b", 1)]
    df = spark.createDataFrame([(i, t, "p", "r", "e") for i, t in enumerate("cab")], "id long, title string, platform string, region string, edition string")
    page, total = search.result_page(df, search.snapshot(df), 2, 1)
    assert total == 3 and [r["title"] for r in page.collect()] == ["b", "c"]
    with pytest.raises(LookupError):
        search.result_page(df, 2, 2, 99)
    assert search.selected_types(["any"]) is None and search.selected_types(["documentation", "disc"]) == ["disc", "manual", "map"]
    rec = spark.createDataFrame([(1, "s", "r1"), (2, "s", "r2")], "record_id long, source_id string, source_record string")
    known = spark.createDataFrame([(7, "s", "identifier", "source_record", "r1"), (6, "t", "identifier", "source_record", "r1")], "release_id long, source_id string, field string, qualifier string, value string")
    assert [tuple(r) for r in reference.known_editions(rec, known).collect()] == [(1, 7)]
    items = spark.createDataFrame([(1, 0, [2, 9])], "item_id long, release_id long, candidates array<long>")
    claims_ = spark.createDataFrame([(2, "s", "old", 1, 1, 1), (2, "s", "new", 2, 1, 1)], "release_id long, source_id string, value string, k1 long, k2 int, k3 long")
    told = reference.described_items(items, df, claims_).orderBy("pos").collect()
    assert [(r["pos"], r["id"], r["titles"] and r["titles"][0]["value"]) for r in told] == [(0, 0, None), (1, 2, "new")]


def test_assets_of_one_id_tell_their_sources_in_one_order(spark, sf, tmp_path):
    """Two sources share asset 320011: its SQL leaves their order open, ours doesn't depend on that of the rows."""
    line = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1).drop("l_orderkey", "l_partkey", "l_linenumber", "l_suppkey")
    told = []
    for n, keys in enumerate([[(2, 11), (1, 10_011)], [(1, 10_011), (2, 11)]]):
        d = str(tmp_path / str(n))
        rows = spark.createDataFrame([(3, 7, number, supplier) for number, supplier in keys], "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long")
        rows.coalesce(1).crossJoin(line).write.parquet(f"{d}/lineitem.parquet")
        spark.read.parquet(f"{sf}/part.parquet").where("p_partkey = 7").write.parquet(f"{d}/part.parquet")
        [row] = registry.queries()["whole_entries"](spark, d).collect()
        con = duckdb.connect()
        for t in ("lineitem", "part"):
            con.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
        cur = con.execute(registry.oracle_sql()["whole_entries"])
        [theirs] = [dict(zip([c[0] for c in cur.description], r)) for r in cur.fetchall()]
        assert {k: v for k, v in row.asDict().items() if k != "assets"} == {k: v for k, v in theirs.items() if k != "assets"}
        assert sorted(re.split("[:;|]", row["assets"])) == sorted(re.split("[:;|]", theirs["assets"]))
        told.append([a.split(":")[2] for a in row["assets"].split("|")])
    assert told == [["src2@1;src3@1;src2@2;src3@2"] * 2] * 2
