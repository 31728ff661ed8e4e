"""The queue, discovery and failures as streams; readers that have to refuse what is broken."""

import json
import os

import pytest
from lodestack.functions.blake3 import blake3
from lodestack.operators import planning
from lodestack.sources import datafiles, objects, paging, stores
from lodestack.streaming import discovery, queue
from pyspark.sql import functions as F

EVENTS = "run_id long, work_key string, seq long, event string"


def run(stream, keep, checkpoint):
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start().awaitTermination()


def test_replayed_events_move_nothing(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(str(src))

    def keep(df, _):
        out.append(sorted(tuple(r) for r in df.collect()))

    def add(*events):
        spark.createDataFrame([(1, "k", *e) for e in events], EVENTS).write.mode("append").parquet(str(src))
        run(queue.states(stream), keep, tmp_path / "cp")

    add((1, "enqueue"), (3, "requeue"), (2, "park"))
    add((1, "enqueue"), (2, "park"), (3, "requeue"))
    run(queue.states(stream), keep, tmp_path / "cp")  # a restart without events
    add((4, "finish"))
    assert [o for o in out if o] == [[(1, "k", "queued", 3)], [(1, "k", "queued", 3)], [(1, "k", "done", 4)]]


def test_parked_items_are_told_of_when_overdue(spark, tmp_path):
    src, out = tmp_path / "in", []
    src.mkdir()
    stream = spark.readStream.schema(EVENTS).parquet(str(src))

    def keep(df, _):
        out.extend(tuple(r) for r in df.collect())

    def add(*events):
        spark.createDataFrame(list(events), EVENTS).write.mode("append").parquet(str(src))

    add((1, "a", 1, "enqueue"), (1, "a", 2, "park"), (1, "b", 1, "enqueue"))
    q = queue.states(stream, 1).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="200 milliseconds").start()
    for _ in range(60):
        if any(r[4] for r in out):
            break
        q.awaitTermination(1)
    q.stop()
    assert [r for r in out if r[4]] == [(1, "a", "parked", 2, True)]


def test_a_batch_of_failures_counts_once(spark, tmp_path):
    kind, src, log, cp = "source_id string, message string", tmp_path / "in", tmp_path / "log", tmp_path / "cp"
    spark.createDataFrame([("s", "x"), ("t", "y")], kind).write.parquet(str(src))
    stream = spark.readStream.schema(kind).parquet(str(src))

    def go():
        queue.failure_log(stream, f"file://{log}", str(cp)).trigger(availableNow=True).start().awaitTermination()

    go()
    for f in (cp / "commits").iterdir():  # as if the stream had stopped before it noted the batch
        f.unlink()
    go()
    assert spark.read.parquet(str(log)).count() == 2
    spark.createDataFrame([("s", "z")], kind).write.mode("append").parquet(str(src))
    go()
    got = spark.read.parquet(str(log))
    assert got.count() == 3 and got.select("batch").distinct().count() == 2


def test_discovery_goes_on_where_it_stopped(spark, tmp_path):
    games, record, done = f"file://{tmp_path}/games", f"file://{tmp_path}/record", tmp_path / "done"
    spark.createDataFrame([(f"g{k}", "p") for k in range(7)], "title string, platform string").coalesce(1).write.option("parquet.block.size", 64).parquet(games)
    fail = {"after": False}

    def work(rows, batch):
        rows.write.mode("overwrite").parquet(f"{done}/batch={batch}")

    def each(rows, batch):
        discovery.recording(record, work)(rows, batch)
        if fail["after"]:
            raise RuntimeError("stopped after the record was advanced")

    def go():
        discovery.slices(spark, games, record, {"a": 3, "b": 5}).writeStream.foreachBatch(each).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    def found():
        return sorted((r["source_id"], r["position"], r["title"], r["first_game"]) for r in spark.read.parquet(str(done)).collect())

    go()
    assert found() == [("a", k, f"g{k}", 0) for k in range(3)] + [("b", k, f"g{k}", 0) for k in range(5)]
    fail["after"] = True
    with pytest.raises(Exception, match="stopped after"):
        go()
    fail["after"] = False
    for _ in range(4):
        go()
    assert found() == [("a", k, f"g{k}", k // 3 * 3) for k in range(7)] + [("b", k, f"g{k}", k // 5 * 5) for k in range(7)]
    book = discovery.Record(record)
    assert book.games("a") == 7 and not book.advance("a", 3, 6) and book.games("a") == 7
    assert [discovery.batch_size(*x) for x in ((20, 1), (20, 3), (2, 9), (20, 0))] == [20, 6, 1, 20]


def pages(folder, listing, **answers):
    os.makedirs(f"{folder}/{listing}", exist_ok=True)
    for name, answer in answers.items():
        with open(f"{folder}/{listing}/{name}.json", "w") as f:
            json.dump(answer, f)


def test_pages_follow_cursors(spark, tmp_path):
    pages(tmp_path, "one", first={"items": [{"identifier": "a", "title": "Console Manual: Quest (US)"}], "cursor": "c2"}, c2={"items": [{"identifier": "b", "title": ["Console Manual: Other (EU)", "x"]}, {"title": "Console Manual: No"}], "cursor": ""})
    pages(tmp_path, "two", first={"items": []})
    got = paging.paged(spark, f"file://{tmp_path}")
    assert sorted((r["listing"], r["page"], r["place"]) for r in got.collect()) == [("one", 1, 0), ("one", 2, 1), ("one", 2, 2)]
    found = sorted((r["identifier"], r["title"], r["platform"], r["region"]) for r in paging.manuals(got).collect())
    assert found == [("a", "Quest", "Console", "USA"), ("b", "Other", "Console", "Europe")]


@pytest.mark.parametrize(
    ("answers", "told"),
    [
        ({"first": {"items": [], "cursor": "x"}}, "no page x"),
        ({"first": {"items": [], "cursor": "x"}, "x": {"items": [], "cursor": "first"}}, "comes back to its page first"),
        ({"first": {"total": 1}}, "without its items"),
        ({"first": {"items": [], "cursor": "x"}, "x": {"items": [], "cursor": "y"}, "y": {"items": []}}, "runs past 2 pages"),
    ],
)
def test_broken_listings_are_errors(spark, tmp_path, answers, told):
    pages(tmp_path, "one", **answers)
    with pytest.raises(Exception, match=told):
        paging.paged(spark, f"file://{tmp_path}", 2).collect()


@pytest.mark.parametrize(
    ("text", "told"),
    [
        ('game ( name "abc rom ( sha1 x ) )', "ends inside a quoted text"),
        ('( name "x" )', "has an entry without a kind"),
        ("game name", "has a game entry without its fields"),
        ("game ( name x ) game", "has a game entry without its fields"),
        ("game ( name )", "has a field name without a value"),
        ("game ( ( x y ) )", "has a block without a name"),
        ("game ( name x rom ( sha1 y )", "ends inside a block"),
        ("game ( name", "has a field name without a value"),
    ],
)
def test_malformed_game_lists(spark, tmp_path, text, told):
    with pytest.raises(ValueError, match=told):
        list(datafiles.blocks(text))
    (tmp_path / "list.dat").write_text(text)
    with pytest.raises(Exception, match=f"list.dat {told}"):
        datafiles.game_list(spark, str(tmp_path)).collect()


def test_blocks_of_game_lists():
    text = 'clrmamepro ( name "A (B)" ) game ( name x rom ( name y sha1 "1" ) rom ( sha1 2 extra ( deep z ) ) )game(name"q")'
    assert list(datafiles.blocks(text)) == [
        (0, "clrmamepro", "name", "A (B)", -1), (1, "game", "name", "x", -1), (1, "game", "name", "y", 0), (1, "game", "sha1", "1", 0),
        (1, "game", "sha1", "2", 1), (1, "game", "deep", "z", 1), (2, "game", "name", "q", -1),
    ]
    assert list(datafiles.blocks("")) == list(datafiles.blocks(None)) == []


def test_cut_off_datafiles_are_errors(spark, tmp_path):
    whole = '<?xml version="1.0"?>\n<!DOCTYPE datafile>\n<datafile><header><name>P</name></header><game name="a"/><game name="b"/></datafile>\n<!-- end -->\n'
    (tmp_path / "a.dat").write_text(whole)
    assert sorted(r["name"] for r in datafiles.releases(spark, str(tmp_path)).collect()) == ["a", "b"]
    assert datafiles.releases(spark, str(tmp_path), 1).count() == 1
    (tmp_path / "b.dat").write_text(whole[: whole.index('<game name="b"') + 8])
    with pytest.raises(Exception, match="b.dat ends before its end"):
        datafiles.releases(spark, str(tmp_path)).collect()


def test_thumbnails_need_a_platform(spark):
    wanted = spark.createDataFrame([("GB", "A/B"), ("GB", "C")], "platform string, title string")
    listings = spark.createDataFrame([("GB", "Snaps", ["A_B.png", "D.png"])], "platform string, folder string, files array<string>")
    repositories = spark.createDataFrame([("GB", "gb.git")], "platform string, repository string")
    got = planning.thumbnails(wanted, repositories, listings, {"shot": "Snaps", "box": "Boxes"})
    assert sorted((r["asset_type"], r["candidate_id"], r["file_name"]) for r in got.collect()) == [("box", "gb.git/Boxes/A/B", "A_B.png"), ("box", "gb.git/Boxes/C", "C.png"), ("shot", "gb.git/Snaps/A/B", "A_B.png")]
    with pytest.raises(Exception, match="no repository is declared"):
        planning.thumbnails(wanted, repositories.where("false"), listings, {"shot": "Snaps"}).collect()


#: Published test vectors: the digest of so many bytes that count up modulo 251.
VECTORS = {
    0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262",
    1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
}


def test_blake3_vectors(spark):
    rows = spark.createDataFrame([(n, bytearray(k % 251 for k in range(n))) for n in VECTORS] + [(-1, None)], "n long, content binary")
    assert {r["n"]: r["h"] for r in rows.select("n", blake3("content").alias("h")).collect()} == VECTORS | {-1: None}


def test_objects_are_verified(spark, tmp_path):
    folder = f"file://{tmp_path}/store"
    contents = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"two"),), (bytearray(b"one"),)], "content binary")
    done = stores.store_objects(contents, folder, "blake3").collect()
    assert len(done) == 2 and all(r["written"] for r in done)
    first, second = sorted(r["object_hash"] for r in done)
    place = lambda h: tmp_path / "store" / h[:2] / h[2:4] / h
    place(first).write_bytes(b"xxx")  # as long as it was
    recorded = spark.createDataFrame([(first,), (second,), ("f" * 64,)], "object_hash string")
    got = {r["object_hash"]: r["state"] for r in objects.examined(spark, folder, recorded, "blake3").collect()}
    assert got == {first: "corrupt", second: "intact", "f" * 64: "missing"}
    again = {r["object_hash"]: r["written"] for r in stores.store_objects(contents, folder, "blake3").collect()}
    assert again == {first: True, second: False}
    assert {r["state"] for r in objects.examined(spark, folder, recorded.where(F.col("object_hash") != "f" * 64), "blake3").collect()} == {"intact"}
