"""Merges, moves, decisions, ranks and duplicate imports against plain code."""

import random

import pytest
from lodestack.functions import text
from lodestack.operators import importing, linking, ranks, reviews, snapshots
from pyspark.sql import functions as F
from tests.test_importing import CLAIMS, EDITIONS, ITEMS, SETS, Plain

MERGES = "from_id long, into_id long, seq long"


def test_chains_of_merges_equal_merges_in_order(spark):
    rng = random.Random(5)
    claims, merges, gone = {}, [], set()
    for k in range(300):
        claims[rng.randrange(40), rng.choice("st"), "f", "", rng.choice("uvw")] = (f"l{k}", k)
    before = [(r, s, loc, f, q, v, n) for (r, s, f, q, v), (loc, n) in claims.items()]
    items = {i: rng.sample(range(40), 4) for i in range(12)}
    asked = [(i, list(c)) for i, c in items.items()]
    for seq in range(30):
        a, b = rng.sample([x for x in range(40) if x not in gone], 2)
        merges.append((a, b, seq))
        gone.add(a)
        for (r, *rest), row in [(k, v) for k, v in claims.items() if k[0] == a]:
            del claims[r, *rest]
            claims.setdefault((b, *rest), row)
        for i, c in items.items():
            if a in c:
                items[i] = [x for x in c if x != a] + ([] if b in c else [b])
    m = spark.createDataFrame(merges, MERGES).repartition(3)
    left, moved = snapshots.merged(spark.range(40), spark.createDataFrame(before, CLAIMS), m)
    assert sorted(r["id"] for r in left.collect()) == sorted(set(range(40)) - gone)
    assert {(r["release_id"], r["source_id"], r["field"], r["qualifier"], r["value"]): (r["location"], r["seq"]) for r in moved.collect()} == claims
    got = snapshots.renamed_candidates(spark.createDataFrame(asked, "item_id long, candidates array<long>"), m)
    assert {r["item_id"]: r["candidates"] for r in got.collect()} == items
    sets = snapshots.merged_sets(spark.createDataFrame([("s", "r", 1, "d")], SETS), spark.createDataFrame([(1, 2, 0), (2, 3, 1)], MERGES))
    assert [r["release_id"] for r in sets.collect()] == [3]


@pytest.mark.parametrize("ring", [[(1, 2, 0), (2, 1, 1)], [(1, 2, 0), (2, 3, 1), (3, 1, 2)]])
def test_rings_of_merges_are_errors(spark, ring):
    with pytest.raises(ValueError):
        snapshots.resolved(spark.createDataFrame(ring, MERGES))


def test_decisions_in_their_order(spark):
    items = spark.createDataFrame([(1, "pending", 1, [7]), (2, "accepted", 1, [7]), (3, "deferred", 2, [7])], "item_id long, status string, seen long, candidates array<long>")
    asked = [(1, "defer", 1, 1, None), (1, "accept", 1, 2, 8), (1, "accept", 1, 3, 7), (1, "reject", 1, 4, None), (2, "reject", 1, 5, None), (2, "reject", 9, 6, None), (3, "accept", 1, 7, 7), (3, "reject", 2, 8, None), (4, "defer", 1, 9, None)]
    decisions = spark.createDataFrame(asked, "item_id long, decision string, seen long, seq long, release_id long")
    got = {r["seq"]: r["outcome"] for r in reviews.decision_outcomes(items, decisions).collect()}
    assert got == {1: "applied", 2: "not_competing", 3: "applied", 4: "final", 5: "final", 6: "changed", 7: "changed", 8: "applied", 9: "not_found"}
    now = {r["item_id"]: (r["status"], r["outcome"]) for r in reviews.decided(items, decisions).collect()}
    assert now == {1: ("accepted", "applied"), 2: ("accepted", "final"), 3: ("rejected", "applied")}
    assert tuple(reviews.decision_summary(items, reviews.decided(items, decisions)).first()) == (2, 0)


def test_rejected_work_is_done_in_cancelled_runs(spark):
    work = spark.createDataFrame([(1, "cancelled", 1, "parked", 1), (1, "cancelled", 2, "parked", 2), (2, "completed", 3, "parked", 2)], "run_id long, status string, work_id long, state string, item_id long")
    items = spark.createDataFrame([(1, "rejected"), (2, "accepted")], "item_id long, status string")
    got = {r["work_id"]: (r["status"], r["state"], r["dismissed"]) for r in reviews.requeued(work, items).collect()}
    assert got == {1: ("cancelled", "done", True), 2: ("cancelled", "parked", False), 3: ("running", "queued", False)}


def moved(plain, source, record, chosen, seq):
    """One decision, on lists."""
    item = plain.items.get((source, record))
    if item is None or item[3] != "pending":
        return "not_pending"
    left, _, candidates, _ = item
    if chosen not in candidates or any((e, s, f, q) == (chosen, source, "identifier", "source_record") for e, s, f, q, _ in plain.claims):
        return "not_a_candidate"
    location = plain.claims[left, source, "identifier", "source_record", record][0]
    for e, s, f, q, v in [k for k in plain.claims if k[:2] == (left, source)]:
        row = plain.claims.pop((e, s, f, q, v))
        if (f, q) != ("identifier", "linked_by"):
            plain.claims.setdefault((chosen, s, f, q, v), row)
    plain.claim(chosen, source, location, "identifier", "linked_by", "review", seq)
    dumps = plain.sets.get((source, record), (None, None))[1]
    if dumps:
        plain.sets[source, record] = (chosen, dumps)
    plain.items[source, record] = (chosen, item[1], candidates + [left], "linked")
    if dumps:
        plain.peers(source, chosen, dumps)
    return "decided"


def test_linked_records_move_alone(spark):
    """s3's record was linked by its dumps to one edition, and then another with the same dumps came."""
    place = ("GB", "USA", "Standard")
    plain = Plain()
    for row in [(10, "s0", "a", "f", "One", *place, "d"), (11, "s3", "b", "f", "Other", *place, "d"), (12, "s1", "c", "f", "Two", *place, "e"), (13, "s4", "g", "f", "Three", *place, "d"), (14, "s1", "c", "f", "Two", *place, "d")]:
        plain.add(*row)
    assert plain.items[("s3", "b")][3] == "pending" and plain.items[("s4", "g")][3] == "pending"
    old = plain.tables()
    frames = [spark.createDataFrame(old[n], s) for n, s in (("editions", EDITIONS), ("claims", CLAIMS), ("sets", SETS), ("items", ITEMS))]
    asked = [("s3", "b", 12, 50), ("s4", "g", 99, 51), ("s9", "x", 1, 52)]
    got = importing.moved_links(*frames, spark.createDataFrame(asked, "source_id string, record_id string, release_id long, seq long"))
    want = {(s, r): moved(plain, s, r, c, n) for s, r, c, n in asked}
    assert {(r["source_id"], r["record_id"]): r["outcome"] for r in got["outcomes"].collect()} == want
    assert want == {("s3", "b"): "decided", ("s4", "g"): "not_a_candidate", ("s9", "x"): "not_pending"}
    for name in ("claims", "sets", "items"):
        assert sorted(map(tuple, got[name].collect())) == plain.tables()[name], name


def test_ranks_without_a_task_per_group(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "hot", "b", None]), k) for k in rng.sample(range(5000), 900)]
    got = ranks.ranked(spark.createDataFrame(rows, "g string, n long"), ["g"], ["n"], "rank", "size", 7)
    groups = {}
    for g, n in sorted(rows, key=lambda r: r[1]):
        groups.setdefault(g, []).append(n)
    assert {(r["g"], r["n"]): (r["rank"], r["size"]) for r in got.collect()} == {(g, n): (k + 1, len(own)) for g, own in groups.items() for k, n in enumerate(own)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_duplicate_imports_equal_nested_loops(spark):
    rng = random.Random(8)
    editions = [(i, i % 3, rng.choice(["A", "a "]), "GB", "USA", "x") for i in range(6)]
    assets = [(k, rng.randrange(6), "disc", rng.choice("oh"), 5) for k in range(30)]
    provenance = [(k, rng.choice("st"), rng.choice(["/a/b", "/a//b", "/a/./c/../b", "a/b", "/x"])) for k in range(30)]
    records = [(k, rng.choice("st"), rng.choice(["/a/b", "a/b", "/x"]), "disc", rng.choice("oh"), 5, "A", "gb", "USA", "X", rng.choice([None, 0, 1]), rng.choice([None, 3, 4])) for k in range(40)]
    norm = lambda p: p if not p.startswith("/") else __import__("posixpath").normpath(p)
    want = {}
    for r in records:
        hits = [a for a, (p, (_, rel, t, h, n)) in enumerate(zip(provenance, assets)) if (p[1], norm(p[2]), t, h, n) == (r[1], norm(r[2]), *r[3:6]) and (r[10] is None or editions[rel][1] == r[10]) and (r[11] is None or rel == r[11])]
        if hits:
            want[r[0]] = min(hits)
    frames = [(records, "record_id long, source_id string, location string, asset_type string, object_hash string, byte_len long, title string, platform string, region string, edition string, game_id long, release_id long"), (provenance, "asset_id long, source_id string, location string"), (assets, "asset_id long, release_id long, asset_type string, object_hash string, byte_len long"), (editions, "id long, game_id long, title string, platform string, region string, edition string")]
    got = linking.existing_imports(*[spark.createDataFrame(*f) for f in frames])
    assert {r["record_id"]: r["asset_id"] for r in got.collect()} == want and want


def test_platform_names_are_trimmed_at_each_step(spark):
    names = ["  GB (Headered)", "GB  (Headered)  (Decrypted) ", "GB(Headered)", "GB (Headered) X", "(Headered)", None]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select(text.platform_name(F.col("n")))
    assert [r[0] for r in rows.collect()] == ["GB", "GB", "GB(Headered)", "GB (Headered) X", "(Headered)", None]




def test_software_names(spark):
    told = {
        "Zelda no Densetsu (Jpn, Rev. A)": ("Zelda no Densetsu", "Japan", "Rev A", "Rev A"),
        "Game (Euro, USA, Prototype) (Alt, Jpn)": ("Game", "Europe, USA", None, "Prototype · Alt · Jpn"),
        "Plain": ("Plain", "Unknown", None, "Standard"),
        "Old (World, Rev 1) (v2.0)": ("Old", "World", "v2.0", "Rev 1 · v2.0"),
    }
    rows = spark.createDataFrame([(k,) for k in told], "d string").select("d", text.software_name(F.col("d")).alias("n"))
    assert {r["d"]: tuple(r["n"]) for r in rows.collect()} == told


def test_software_releases(spark, tmp_path):
    from lodestack.sources import datafiles

    lists = {
        "nes.xml": '<softwarelist name="nes" description="NES carts"><software name="a" cloneof="b"><description>A (USA)</description><year>1990</year></software><software name="c"><description> </description></software></softwarelist>',
        "odd.xml": '<softwarelist name="odd" description=" Odd things "><software name="x"><description>X</description><publisher>P</publisher></software></softwarelist>',
    }
    for name, content in lists.items():
        (tmp_path / name).write_text(content)
    got = {r["file"]: (r["platform"], r["title"], r["region"], [tuple(i) for i in r["identifiers"]]) for r in datafiles.software_releases(spark, str(tmp_path)).collect()}
    assert got == {
        "nes.xml": ("Nintendo - Nintendo Entertainment System", "A", "USA", [("source_record", "3:nesa"), ("software_list", "nes"), ("software", "a"), ("clone_of", "b"), ("year", "1990")]),
        "odd.xml": ("Odd things", "X", "Unknown", [("source_record", "3:oddx"), ("software_list", "odd"), ("software", "x"), ("publisher", "P")]),
    }


@pytest.mark.parametrize(
    ("content", "told"),
    [
        ('{"format_version": 1, "request": {"games": ["a"]}}', None),
        ('{"format_version": 2, "request": {}}', "has the version 2 and not 1"),
        ('{"format_version": 1, "request": {"gams": 1, "Games": 2}, "more": 1}', "has unknown keys: Games, gams, more"),
        ("[1]", "is no request document"),
        ("not json", "is no request document"),
    ],
)
def test_request_documents(spark, tmp_path, content, told):
    from lodestack.sources import requests

    (tmp_path / "r.json").write_text(content)
    rows = requests.documents(spark, str(tmp_path))
    if told:
        with pytest.raises(Exception, match=f"r.json {told}"):
            rows.collect()
    else:
        assert [r["request"] for r in rows.collect()] == ['{"games":["a"]}']


def test_counts_of_work_below_quality(spark):
    from lodestack.operators import runs

    work = spark.createDataFrame([(1, "done", "", False, False, "small", None), (1, "done", "", False, False, None, "h"), (1, "done", "", False, False, None, None)], "run_id long, state string, review_status string, unavailable boolean, skipped boolean, shortfalls string, outranked_by string")
    row = runs.counters(spark.createDataFrame([(1, "running")], "run_id long, status string"), work).first()
    assert (row["done"], row["below_quality"], row["outranked"]) == (3, 1, 1)


def test_requirements_that_cannot_be_applied(spark):
    from lodestack.operators import summaries

    kind = "request_id int, max_compression_ratio double, min_bitrate_kbps int, preferred_scan_type string, preferred_sources array<string>, best_available boolean"
    rows = [(1, None, None, None, [], False), (2, 0.5, 3, None, None, True), (3, None, 3, None, None, False), (4, None, None, None, ["a"], True), (5, None, None, "x", None, False), (6, None, None, None, None, True)]
    got = {r["request_id"]: (r["unsupported"] or "").split(" ")[0] for r in summaries.unsupported_requirement(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "", 2: "compression", 3: "bitrates", 4: "scan", 5: "scan", 6: "best-available"}


def test_local_imports(spark, tmp_path):
    import hashlib

    from lodestack.sources import objects

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(b"\x89PNG\r\n")
    rows = spark.createDataFrame([(f"{tmp_path}/./in//a.png", "box_front")], "path string, asset_type string")
    got = objects.local_imports(spark, rows, str(tmp_path)).first()
    assert (got["original_filename"], got["source_location"], got["byte_len"], got["media_type"]) == ("a.png", f"{tmp_path}/in/a.png", 6, "image/png")
    assert got["object_hash"] == hashlib.sha256(b"\x89PNG\r\n").hexdigest()
    with pytest.raises(Exception, match="no file to import"):
        objects.local_imports(spark, spark.createDataFrame([(f"{tmp_path}/in", "x")], "path string, asset_type string"), str(tmp_path)).collect()


def test_titles_of_shared_atlases(spark):
    rows = [("Prince (Game Boy Color)", "GB-GBC"), ("Prince (Game Boy Color)", "NES"), ("Quest  (gb)", "GB-GBC"), ("A (B) (CD-ROM 2)", "TG16"), ("A (B)", "TG16"), ("Plain", "NES"), ("X (FDS) ", "NES")]
    df = spark.createDataFrame(rows, "t string, a string").select(text.atlas_title(F.col("t"), F.col("a")).alias("n"))
    assert [tuple(r["n"]) for r in df.collect()] == [
        ("Prince", "Nintendo - Game Boy Color"), ("Prince (Game Boy Color)", None), ("Quest", "Nintendo - Game Boy"), ("A (B)", "NEC - PC Engine CD - TurboGrafx-CD"), ("A (B)", None), ("Plain", None), ("X (FDS) ", None),
    ]


def test_hot_titles_change_nothing(spark, sf, monkeypatch):
    from lodestack.operators import matching
    from lodestack.plans.bridge import relation

    candidates, releases = (relation(spark, sf, n) for n in ("candidates", "release_editions"))
    usual = sorted(map(tuple, matching.competing(candidates, releases).collect()))
    monkeypatch.setattr(matching, "HOT_TITLE", 2)
    assert sorted(map(tuple, matching.competing(candidates, releases).collect())) == usual and usual
