import functools
import pathlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lodestack.llm import packing, token_store, tokens
from lodestack.llm.common import materialise, new_path, numbered


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def whole(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


TEXTS = [(None, "no id"), (1, None), (2, ""), (3, "Été – naïve ☃ text"), (4, "same text here"), (5, "same text here"), (7, "word " * 5000), (7, "again"), (7, "again"), (9, "a\xa0b\x85 c <|endoftext|> ' 's 12\n\n  x")]


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in TEXTS], "doc_id long, text string, start string, n int")


def test_fast_encoding_equals_the_library():
    rng = random.Random(5)
    code = tokens.Encoder(tokens.vocabulary_path())
    for _ in range(3000):
        text = "".join(rng.choice("ab c'sS\n\t \xa0\x85\x1c12é²ªß.,!<|endoftext|>\xad\x00'll re ve☃") for _ in range(rng.randint(0, 40)))
        if rng.random() < 0.2:
            text += rng.choice(["<|endoftext|>", " <|endoftext|><|endoftext|> x"])
        assert np.frombuffer(code.encode(text), code.kind).tolist() == whole(text)[:-1]


@pytest.mark.parametrize("change", ["prefix", "lower", "wide"])
def test_other_vocabulary_files_are_followed(tmp_path, change):
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    other = Tokenizer.from_file(tokens.vocabulary_path())
    if change == "prefix":
        other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True)
    elif change == "lower":
        other.normalizer = normalizers.Lowercase()
    else:
        other.add_tokens([f"<extra{i}>" for i in range(20_000)])
    other.save(str(tmp_path / "t.json"))
    code = tokens.Encoder(str(tmp_path / "t.json"))
    for text in ("Some Text <extra19999> and more", "", "x"):
        assert np.frombuffer(code.encode(text), code.kind).tolist() == other.encode(text, add_special_tokens=False).ids


def test_store_round_trip(spark, docs):
    folder = new_path(spark, "store")
    token_store.write_store(docs, folder)
    got = sorted(tuple(r) for r in token_store.read_store(spark, folder).collect() if r[0] is not None)
    expected, at = [], len(whole("no id"))
    for i, t in sorted((x for x in TEXTS if x[0] is not None), key=lambda x: (x[0], len(whole(x[1])))):
        ids = whole(t)
        expected.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == sorted(expected)
    back = token_store.read_ids(spark, folder, docs.where("doc_id in (3, 7, 9)"))
    assert sorted((r[0], r[2]) for r in back.collect()) == sorted((i, whole(t)) for i, t in TEXTS if i in (3, 7, 9))
    chunks = spark.read.parquet(f"{folder}/parts").where("kind = 1")
    assert chunks.count() == chunks.select("key").distinct().count()


def test_store_notices_damage(spark, docs):
    folder = new_path(spark, "store")
    token_store.write_store(docs, folder)
    parts = spark.read.parquet(f"{folder}/parts").where("kind = 1").withColumn("data", __import__("pyspark.sql.functions", fromlist=["x"]).expr("cast(concat(data, x'0000') as binary)"))
    other = new_path(spark, "damaged")
    parts.write.partitionBy("kind").parquet(f"{other}/parts")
    spark.read.parquet(f"{folder}/recipes").write.parquet(f"{other}/recipes")
    with pytest.raises(Exception, match="digest"):
        token_store.read_store(spark, other).collect()


@pytest.mark.parametrize("damage", ["lost", "doc_id", "start", "manifest"])
def test_store_notices_changed_recipe_files(spark, docs, damage):
    folder = new_path(spark, "store")
    root = token_store.write_store(docs, folder)
    assert token_store.read_store(spark, folder, root).count() == docs.count()
    kind = "manifest" if damage == "manifest" else "recipes"
    file = next(p for p in sorted(pathlib.Path(folder.removeprefix("file://"), kind).glob("*.parquet")) if pq.read_metadata(p).num_rows)
    rows = pq.read_table(file, partitioning=None)
    file.unlink()
    file.with_name(f".{file.name}.crc").unlink()
    if damage in ("doc_id", "start"):
        at = rows.column_names.index(damage)
        rows = rows.set_column(at, damage, pa.array([(x or 0) + 1000 for x in rows.column(damage).to_pylist()], pa.int64()))
        pq.write_table(rows, file)
    with pytest.raises(Exception, match="manifest"):
        token_store.read_store(spark, folder, root).collect()


def test_chunks_follow_content():
    ids = np.random.default_rng(1).integers(0, 50000, 20000).astype("<u2")
    moved = np.concatenate([ids[:37], ids])

    def pieces(x):
        ends = token_store.cuts(x)
        return {x[a:b].tobytes() for a, b in zip([0, *ends], ends)}

    assert b"".join(x for x in [ids[a:b].tobytes() for a, b in zip([0, *token_store.cuts(ids)], token_store.cuts(ids))]) == ids.tobytes()
    assert len(pieces(ids) & pieces(moved)) > 0.8 * len(pieces(ids))


def check_packing(rows, texts):
    taken, by_doc = {}, {}
    for r in rows:
        taken.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    for places in taken.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:]))
        assert sum(n for _, n in places) <= 2048
    for i, t in texts:
        if sum(x[0] == i for x in texts) > 1:
            continue
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        ids = whole(t)
        assert [r["piece"] for r in own] == list(range(len(own)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in own[1:])
    return len(taken)


def test_packing_places_every_piece(spark, docs):
    check_packing(packing.pack(docs).collect(), TEXTS)
    assert packing.pack(docs.limit(0)).count() == 0
    assert check_packing(packing.pack(docs, rows_per_group=1).collect(), TEXTS)


def test_packing_with_every_length_hot_and_one_id(spark):
    texts = [(None, " word" * n) for n in range(2047) for _ in range(2)]
    rows = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), rows_per_group=1).collect()
    assert len(rows) == len(texts) and sorted(r["length"] for r in rows) == sorted(n + 1 for n in range(2047) for _ in range(2))
    assert check_packing(rows, []) == -(-sum(r["length"] for r in rows) // 2048)


@pytest.mark.parametrize("rows_a_part", [1, 7])
def test_numbering_of_one_hot_key(spark, rows_a_part):
    rows = [(None, 3)] * 20 + [(5, 2)] * 10 + [(1, 1), (9, 4)]
    df = materialise(spark.createDataFrame(rows, "k long, w long"), "rows")
    got = sorted((r["start"], r["k"], r["w"]) for r in numbered(df, ["k", "w"], "w", "start", rows_a_part).collect())
    at = 0
    for (start, k, w), (ek, ew) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))):
        assert (start, k, w) == (at, ek, ew)
        at += w
    assert numbered(df.limit(0), ["k"], "w", "start").count() == 0


def least(counts, capacity):
    """Fewest sequences, by trying everything."""
    from functools import cache

    kinds = sorted(counts, reverse=True)

    @cache
    def solve(left):
        if not any(left):
            return 0
        first = next(i for i, n in enumerate(left) if n)
        best = 10**9

        def fill(i, room, now):
            nonlocal best
            for j in range(i, len(kinds)):
                if now[j] and kinds[j] <= room:
                    fill(j, room - kinds[j], now[:j] + (now[j] - 1,) + now[j + 1 :])
            best = min(best, 1 + solve(now))

        fill(first, capacity - kinds[first], left[:first] + (left[first] - 1,) + left[first + 1 :])
        return best

    return solve(tuple(counts[k] for k in kinds))


def test_reduction_keeps_the_optimum():
    rng = random.Random(3)
    for _ in range(60):
        counts = {}
        for _ in range(rng.randint(1, 9)):
            k = rng.randint(2, 20)
            counts[k] = counts.get(k, 0) + 1
        plan = packing.Plan(counts, 20)
        plan.reduce()
        assert plan.fixed + least(dict(plan.left), 20) == least(counts, 20)
        plan.best_fit()
        assert not plan.left and sum(r[2] for r in plan.runs) == sum(counts.values())


def test_plan_is_near_the_bound():
    rng = random.Random(4)
    counts = {}
    for _ in range(200_000):
        k = min(2048, int(rng.lognormvariate(6, 1)) + 1)
        counts[k] = counts.get(k, 0) + 1
    plan = packing.Plan(counts, 2048).solve()
    assert plan.sequences <= -(-sum(k * n for k, n in counts.items()) // 2048) * 1.002 + 1
    assert len(plan.runs) < 100_000


def test_tasks_drop_what_others_kept(monkeypatch):
    from lodestack.llm import common

    held = {"x": {1: 2}, "y": {3: 4}}
    monkeypatch.setattr(common, "KEPT", {n: d.clear for n, d in held.items()})
    assert list(common.lean(iter, "*")([1])) == [1] and held == {"x": {1: 2}, "y": {3: 4}}
    assert list(common.lean(iter, "x")([])) == [] and held == {"x": {1: 2}, "y": {}}
    assert list(common.lean(iter)([])) == [] and held["x"] == {}
