"""Sources of JSON and HTML answers, picture headers and writers, on rows of their own."""

import json
import struct

import pytest
from lodestack.sources import answers, dataset, objects, pictures, sites, stores
from pyspark.sql import functions as F


def _bodies(spark, rows, schema):
    return spark.createDataFrame([(*r[:-1], json.dumps(r[-1])) for r in rows], schema)


def test_screenshots(spark):
    wanted = spark.createDataFrame([("Moon Run", "Sony - PlayStation Portable"), ("Moon Run", "Acme - Box"), ("Other", "Acme - Box")], "title string, platform string")
    on = lambda *names: [{"platform": {"name": n}} for n in names]
    url = "https://media.rawg.io/media/"
    games = [
        {"id": 7, "name": "moon run!", "background_image": url + "b.jpg", "platforms": on("PSP", "BOX"), "short_screenshots": [{"id": -1, "image": None}, {"id": 3, "image": url + "s.png"}, {"id": 4, "image": "https://elsewhere.org/x.png"}]},
        {"id": 8, "name": "Moon Run 2", "background_image": url + "n.jpg", "platforms": on("PSP")},
        {"id": 9, "name": "Moon Run", "background_image": url + "w.jpg?size=1", "platforms": on("Crate"), "short_screenshots": None},
    ]
    got = answers.screenshots(wanted, _bodies(spark, [("Moon Run", {"results": games}), ("Other", {"results": []})], "title string, body string"))
    assert got.columns == answers.CANDIDATE
    ids = {r.candidate_id: r.filename for r in got.collect()}
    assert ids == {f"{p}/{rest}": f for p in ("sonyplaystationportable", "acmebox") for rest, f in (("games/7/background", "b.jpg"), ("screenshots/3", "s.png"))}
    with pytest.raises(Exception, match="without its games"):
        answers.screenshots(wanted, _bodies(spark, [("Moon Run", {"detail": "no"})], "title string, body string")).collect()


def test_boxart(spark):
    wanted = spark.createDataFrame([("Moon Run", "Bandai - WonderSwan"), ("Moon Run", "Acme Box (Digital)")], "title string, platform string")
    listed = _bodies(spark, [({"data": {"platforms": {"1": {"id": 1, "name": "WonderSwan"}, "2": {"id": 2, "name": "Acme Box (AB)"}, "3": {"id": 3, "name": "Bandai WonderSwan"}}}},)], "body string")
    found = _bodies(spark, [("Moon Run", {"data": {"games": [{"id": 10, "game_title": "MOON RUN", "platform": 1}, {"id": 11, "game_title": "Moon Run", "platform": 2}, {"id": 12, "game_title": "Moon Run", "platform": 3}]}})], "title string, body string")
    pictured = {"10": [{"id": 5, "type": "boxart", "side": "front", "filename": "boxart/front/10.jpg"}, {"id": 6, "type": "boxart", "side": "spine", "filename": "x.jpg"}, {"id": 7, "type": "fanart", "side": None, "filename": "fan/10.jpg"}], "11": [{"id": 8, "type": "fanart", "filename": "fan/11.jpg"}]}
    images = _bodies(spark, [({"data": {"base_url": {"original": "https://cdn.example.net/original/"}, "images": pictured}},)], "body string")
    got = {r.candidate_id: (r.asset_type, r.label, r.source_url) for r in answers.boxart(wanted, listed, found, images).collect()}
    assert got == {"image/5": ("box_front", "boxart: front", "https://cdn.example.net/original/boxart/front/10.jpg"), "image/7": ("wallpaper_artwork", "fanart", "https://cdn.example.net/original/fan/10.jpg")}


def test_voted(spark):
    wanted = spark.createDataFrame([("Moon Run", "A - B"), ("Gone", "A - B")], "title string, platform string")
    found = _bodies(spark, [("Moon Run", {"success": True, "data": [{"id": 1, "name": "Moon Runner"}, {"id": 2, "name": "Moon: Run"}, {"id": 3, "name": "Moon Run"}]}), ("Gone", {"success": True, "data": []})], "title string, body string")
    media = _bodies(spark, [(2, "logos", {"success": True, "data": [{"id": 9, "url": "https://x.example/l.png", "style": "white"}, {"id": 10, "url": "http://x.example/l.png"}]}), (3, "icons", {"success": True, "data": [{"id": 11, "url": "https://x.example/i.png"}]})], "game_id long, collection string, body string")
    assert [(r.candidate_id, r.label, r.asset_type) for r in answers.voted(wanted, found, media).collect()] == [("ab/logos/9", "logos: white", "logo")]
    with pytest.raises(Exception, match="without its success"):
        answers.voted(wanted, _bodies(spark, [("Moon Run", {"success": False})], "title string, body string"), media).collect()


def test_lists_of_platforms(spark):
    entry = lambda name, host="raw.githubusercontent.com", kind="file": {"type": kind, "name": name, "download_url": f"https://{host}/{name}".replace(" ", "%20")}
    found = answers.listed_lists(_bodies(spark, [("first", [entry("A - Box.dat"), entry("note.md"), entry("C.dat", "other.org")]), ("second", [entry("A Box.dat"), entry("D.dat", kind="dir")])], "directory string, body string"))
    wanted = spark.createDataFrame([("A Box",), ("a-box",), ("C",)], "platform string")
    assert {r.platform: r.named for r in answers.list_of(wanted, found, ["first", "second"]).collect()} == {"A Box": "A Box", "a-box": "A - Box"}


def test_listed_manuals(spark):
    titles = ["Acme Box Manual: Moon Run (1998)(Maker)(US)[S-1]", "Moon Run [S-1](Acme Box)(EU) -Manual(600DPI)", "Moon Run [S-1](Acme Box)(EU) -Poster", "Moon Run"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(titles)] + [(9, None)], "i int, t string").select("i", answers.listed_manual(F.col("t")).alias("m")).collect()
    got = {r.i: r.m and (r.m.title, r.m.platform, r.m.tags) for r in rows}
    region = spark.createDataFrame([(["1998", "US, JP", "EU"],), (["US, XX"],), ([],), (None,)], "t array<string>").select(answers.manual_region(F.col("t")).alias("r")).collect()
    assert [r.r for r in region] == ["USA, Japan", None, None, None]
    assert got == {0: ("Moon Run", "Acme Box", ["1998", "Maker", "US"]), 1: ("Moon Run", "Acme Box", ["EU"]), 2: None, 3: None, 9: None}


def test_atlas_and_lists(spark):
    atlas = (
        "<table><tr><td colspan=4><table><tr><td colspan='4'>Legend, The Maps</td></tr><tr><td>World&nbsp; 1<td><a href='a/w1.png'>Map</a>"
        "<tr><td><a href='w2.PNG'>Two</a></td><td><a href='/up.png'>no</a> <a href='http://x/y.png'>no</a> <a href=page.html>no</a></td></tr></table></td></tr></table>"
    )
    pages = spark.createDataFrame([(1, atlas), (2, "<a href='b.png'>before any game</a>"), (3, None)], "page_id long, html string")
    maps = sites.atlas_maps(sites.elements(pages)).orderBy("pos").collect()
    assert [(r.page_id, r.title, r.filename, r.label) for r in maps] == [(1, "The Legend", "w1.png", "World 1 · Map"), (1, "The Legend", "w2.PNG", "Two")]
    row = "<tr><td class='x col1'><a href='{0}.html'>i</a></td><td class=col2>s</td><td class=col3>{1}</td></tr>"
    listed = "<table>" + "".join(row.format(*p) for p in [("a", "Moon Run - [ 2 DISCS ]"), ("b", "Twice"), ("c", "TWICE!")]) + "</table>"
    rows = sites.sole_rows(sites.elements(spark.createDataFrame([(1, listed)], "page_id long, html string"))).collect()
    assert [(r.key, r.title, r.href) for r in rows] == [("moonrun", "Moon Run", "a.html")]


def test_scans(spark):
    page = "".join(f"<a href='/images/hires/U/M/{n}.html'>x</a>" for n in ("SL-1-F-ALL", "SL-1-B-GH", "SL-1-D-XX", "SL-1-I-ALL")) + "<a href='/images/hires/P/M/SL-1-F-ALL.html'></a><img src='/images/screens/U/M/1.jpg'><img src='/images/screens/J/M/1.jpg'>"
    rows = sites.scans_and_screens(sites.elements(spark.createDataFrame([(1, page)], "page_id long, html string")), "U").collect()
    assert {(r.candidate_id, r.asset_type, r.label, r.edition) for r in rows} == {
        ("U/M/SL-1-F-ALL", "box_front", "front", "Unspecified"), ("U/M/SL-1-B-GH", "box_back", "back: GH", "Greatest Hits"), ("screens/U/M/1", "screenshot", "screenshot", "Unspecified"),
    }


def _box(kind, content):
    return struct.pack(">I", 8 + len(content)) + kind + content


def test_picture_sizes(spark):
    ispe = lambda w, h: _box(b"ispe", struct.pack(">III", 0, w, h))
    meta = _box(b"meta", b"\0" * 4 + _box(b"iprp", _box(b"ipco", ispe(16, 16) + ispe(70, 50))))
    jxl = b"\xff\x0a" + (0 | 0 << 1 | 49 << 3 | 0 << 12 | 0 << 15 | 69 << 17).to_bytes(8, "little")
    held = {
        "jpeg": b"\xff\xd8\xff\xe0" + struct.pack(">H", 70000 % 65536) + b"\0" * (70000 % 65536 - 2) + b"\xff\xff\xc2" + struct.pack(">HBHH", 17, 8, 50, 70),
        "jpeg cut": b"\xff\xd8\xff\xe0\0\x10",
        "tiff": b"MM\0*\0\0\0\x08" + struct.pack(">H", 2) + struct.pack(">HHIHH", 256, 3, 1, 70, 0) + struct.pack(">HHII", 257, 4, 1, 50),
        "tiff cut": b"II*\0\xff\0\0\0",
        "heif": _box(b"ftyp", b"heic\0\0\0\0mif1") + _box(b"free", b"x" * 100) + meta,
        "jxl": jxl, "jxl box": b"\0\0\0\x0cJXL \r\n\x87\n" + _box(b"ftyp", b"jxl ") + _box(b"jxlp", b"\0\0\0\0" + jxl[:3]) + _box(b"jxlp", b"\x80\0\0\x01" + jxl[3:]),
        "pnm": b"P6 # " + b"c" * 300 + b"\n70#w\n 50\n255\n", "pnm cut": b"P6 70",
        "gif": b"GIF89a" + struct.pack("<HH", 70, 50), "bmp": b"BM" + b"\0" * 12 + struct.pack("<Iii", 40, 70, -50),
        "webp": b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + b"\x45\0\0\x31\0\0", "none": b"", "null": None, "zero": b"GIF89a\0\0\x01\0",
    }
    rows = spark.createDataFrame([(k, v and bytearray(v)) for k, v in held.items()], "k string, content binary").select("k", pictures.picture_size("content").alias("s")).collect()
    got = {r.k: (r.s.width, r.s.height) for r in rows}
    whole = {k for k in held if k not in ("jpeg cut", "tiff cut", "pnm cut", "none", "null", "zero")}
    assert got == {k: (70, 50) if k in whole else (None, None) for k in held}


def test_media_types(spark):
    ftyp = lambda *brands: _box(b"ftyp", brands[0] + b"\0\0\0\0" + b"".join(brands[1:])) + b"mif1"
    held = {
        "video/mp4": ftyp(b"isom", b"mp41"), "video/quicktime": ftyp(b"qt  "), "image/heic": ftyp(b"mif1", b"heic"), "image/avif": ftyp(b"avif", b"mif1"), "image/heif": ftyp(b"isom", b"msf1"),
        "image/webp": b"RIFF\0\0\0\0WEBPVP8 ", "image/jxl": b"\xff\x0a\0", "image/x-portable-anymap": b"P5 1 1", "application/pdf": b"%PDF-1.4", None: b"nothing",
    }
    rows = [(k, bytearray(v)) for k, v in held.items()] + [(None, bytearray()), (None, None), (None, bytearray(b"\0\0\0"))]
    got = spark.createDataFrame(rows, "k string, content binary").select("k", objects.media_type(F.col("content")).alias("m")).collect()
    assert [r.m for r in got] == [r.k for r in got]
    wide = struct.pack(">I4sQ", 1, b"ftyp", 28) + b"mif1" + b"\0" * 4 + b"avis"
    assert spark.createDataFrame([(bytearray(wide),)], "content binary").select(objects.media_type(F.col("content"))).first()[0] == "image/avif"


def test_writers(spark, tmp_path):
    uri = tmp_path.as_uri()
    rows = spark.createDataFrame([(bytearray(b"one"),), (bytearray(b"one"),), (bytearray(b""),), (None,)], "content binary")
    first, again = (stores.store_objects(rows, uri + "/vault").collect() for _ in range(2))
    assert sorted(r.length for r in first) == [0, 3] and all(r.written for r in first) and not any(r.written for r in again)
    held = objects.stored(spark, str(tmp_path / "vault"))
    assert {r.state for r in objects.checked(held).collect()} == {"intact"}
    one = next(r.object_hash for r in first if r.length == 3)
    tree = spark.createDataFrame([("Box/Moon Run/logo/a.png", one), ("Box/Moon Run/logo/b.png", "0" * 64)], "path string, object_hash string")
    assert [tuple(r) for r in stores.export_tree(tree, held, uri + "/tree").collect()] == [("Box/Moon Run/logo/a.png", 3, True)]
    assert (tmp_path / "tree/Box/Moon Run/logo/a.png").read_bytes() == b"one"
    with pytest.raises(Exception, match="outside the tree"):
        stores.export_tree(spark.createDataFrame([("a/../../x", one)], tree.schema), held, uri + "/tree").collect()
    told = stores.as_documents(spark.createDataFrame([(1, None)], "a int, b string")).first()
    assert json.loads(told.value) == {"a": 1, "b": None}


def test_dataset_images(spark, tmp_path):
    game = "<Game><Name> Moon Run </Name><DatabaseID>{}</DatabaseID><Platform>{}</Platform></Game>"
    image = "<GameImage><DatabaseID>{}</DatabaseID><FileName>{}</FileName><Type>{}</Type>{}</GameImage>"
    body = game.format(1, "Acme Box") + game.format(2, "Other") + "<Game><Name>No id</Name><Platform>Acme Box</Platform></Game>" + game.format(3, "<!-- none -->")
    body += image.format(1, "a b.png", "Disc", "<Region>north america</Region>") + image.format(1, "../x.png", "Disc", "") + image.format(1, "c.png", "Cart", "") + image.format(2, "d.png", "Disc", "") + image.format(1, "e.png", "Disc", "<Region> Mars</Region>")
    (tmp_path / "set.xml").write_text(f"<LaunchBox>{body}</LaunchBox>")
    path = str(tmp_path / "set.xml")
    games, images = dataset.records(spark, path, "Game", dataset.GAME), dataset.records(spark, path, "GameImage", dataset.IMAGE)
    assert sorted((r.DatabaseID or "", r.Name) for r in games.collect()) == [("", "No id"), ("1", "Moon Run"), ("2", "Moon Run"), ("3", "Moon Run")]
    wanted = spark.createDataFrame([("moon  run", "Acme - Box")], "title string, platform string")
    dims = {"Acme - Box": "Acme Box"}, {"Disc": "disc"}
    got = dataset.candidates(games, images, wanted, *dims, "https://i.example/images/").collect()
    assert {(r.candidate_id, r.title, r.region, r.source_url) for r in got} == {("1/a b.png", "moon  run", "USA", "https://i.example/images/a%20b.png"), ("1/e.png", "moon  run", "Mars", "https://i.example/images/e.png")}
    assert [r.filename for r in dataset.candidates(games, images, wanted, *dims, "https://i.example/images/", ["usa "]).collect()] == ["a b.png"]
    everything = dataset.candidates(games, images, wanted.select("platform", F.lit(None).cast("string").alias("title")), *dims, "https://i.example/images/")
    assert {r.title for r in everything.collect()} == {"Moon Run"}
