import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from lodestack.llm import bloom, decontaminate, embed_dedup, graph, licenses, line_dedup, ngram_join, perplexity, rtree, sharding, toxicity
from pyspark.sql import functions as F
from lodestack.llm.common import new_path, word_hashes, words

ODD = [(None, "no id at all here"), (1, None), (2, ""), (3, " \t\n"), (4, "Ünï cødé\x0b words\x0c here"), (4, "repeated id"), (5, "x"), (6, "long " * 20_000)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SCHEMA)


def prose(rng, n, vocabulary=400):
    return [f"w{int(rng.paretovariate(0.7)) % vocabulary}" for _ in range(n)]


def test_word_hashes_follow_the_words():
    texts = [t for _, t in ODD] + ["A b a B", "\x85 a\xa0b"]
    hashes = word_hashes(texts)
    assert [len(h) for h in hashes] == [len(words(t)) for t in texts]
    seen = {}
    for t, h in zip(texts, hashes):
        for w, x in zip(words(t), h.tolist()):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    assert words("A b a B") == [b"a", b"b", b"a", b"b"]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 150), rng.randint(0, 150)) for _ in range(90)] + [(500, k) for k in range(501, 560)]
    got = {r["node"]: r["comp"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in pairs)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_bloom_never_denies(spark):
    keys = list(range(0, 3000, 7))
    b = bloom.build(spark.createDataFrame([(k,) for k in keys] + [(None,)], "k long"), len(keys))
    assert b.holds(np.array(keys, np.int64)).all() and b.holds(np.arange(10**6, 10**6 + 20_000)).mean() < 0.02


# --- n-gram join ---------------------------------------------------------------------------------


def shingle_set(text, k):
    w = words(text)
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = comp[i], comp[j]
                comp = [min(a, b) if c in (a, b) else c for c in comp]
    least = {}
    for c, (d, _), s in zip(comp, rows, sets):
        if d is not None:
            least[c] = min(least.get(c, d), d)
    return sorted(((d, len(s), least.get(c, d) if s else d) for c, (d, _), s in zip(comp, rows, sets)), key=str)


@pytest.mark.parametrize(("k", "num", "den", "block"), [(4, 85, 100, 2048), (5, 4, 5, 5)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = random.Random(k)
    passage, rows = prose(rng, 60), list(ODD)
    for g in range(12):
        base = prose(rng, rng.choice([8, 40, 150, 700])) + (passage if g % 2 else [])
        for _ in range(rng.choice([1, 2, 14])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, len(w) // 60])):
                w[rng.randrange(len(w))] = f"e{rng.randint(0, 9)}"
            rows.append((1000 - len(rows), " ".join(w)))
    rows += [(2000, rows[-1][1]), (2001, rows[-1][1].upper()), (None, rows[-3][1])]
    got = ngram_join.jaccard_components(docs_of(spark, rows), k, num, den).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows, k, num, den)
    assert ngram_join.jaccard_components(docs_of(spark, [])).count() == 0


def test_tree_leaves_no_near_pair_out():
    rng = np.random.default_rng(3)
    sets = []
    for n in (20, 300, 300, 1500, 9000):
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        for _ in range(9):
            s = base.copy()
            s[rng.integers(0, n, n // 20)] = rng.integers(0, 1 << 63, n // 20)
            sets.append(np.unique(s))
    n = np.array([len(s) for s in sets])
    points = rtree.Points([rtree.point(s).tobytes() for s in sets], n)
    i, j = rtree.join(points, slice(0, len(n)), 4, 5)
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    true = {(a, b) for b in range(len(n)) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))}
    assert true and true <= found and len(found) < 0.5 * len(n) * (len(n) - 1) / 2


# --- decontamination -----------------------------------------------------------------------------


def slow_tiles(a, b, least):
    free_a, free_b, covered = [True] * len(a), [True] * len(b), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        n, i, j = best[0], -best[1], -best[2]
        if n < least:
            return covered
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
        covered += n


def test_tiles_equal_the_plain_greedy_form():
    rng = random.Random(2)
    for trial in range(90):
        kinds = 60 if trial % 3 else 2
        a = [rng.randint(0, 3) if rng.random() < 0.2 else rng.randint(0, kinds) for _ in range(rng.randint(6, 40))]
        b = [rng.randint(0, 60) for _ in range(10)]
        for _ in range(3):
            s = rng.randrange(len(a))
            b += a[s : s + rng.randint(3, 25)] + [rng.randint(0, 60)]
        tiles = decontaminate.greedy_tiles(np.array(a, np.uint64), np.array(b, np.uint64), 4)
        for i, j, n in tiles:
            assert a[i : i + n] == b[j : j + n] and n >= 4
        for at in (0, 1):
            used = [x for t in tiles for x in range(t[at], t[at] + t[2])]
            assert len(used) == len(set(used))
        assert sum(t[2] for t in tiles) == slow_tiles(a, b, 4)


@pytest.mark.parametrize("hits", [3, 1 << 16])
def test_leaks_equal_brute_force_with_repeated_seeds(spark, monkeypatch, hits):
    monkeypatch.setattr(decontaminate, "HITS", hits)
    rng = random.Random(16)
    items = [(1, "alpha beta gamma delta eps " * 20), (2, "one two three " * 24), (3, "word " * 60), (4, " ".join(prose(rng, 40, 30))), (5, "a b"), (6, " ".join(prose(rng, 30, 3)))]
    rows = [(10 + i, t) for i, (_, t) in enumerate(items)] + [(20, "word " * 29), (21, "word " * 31), (22, "one two three " * 11), (None, "x a b x"), (None, "x a b x")]
    rows += [(30 + i, " ".join(prose(rng, 60, rng.choice([3, 30])))) for i in range(25)]
    expected = Counter()
    for d, t in rows:
        for i, x in items:
            covered = slow_tiles(words(x), words(t), min(5, len(words(x))))
            if covered >= 0.5 * len(words(x)):
                expected[d, i, covered] += 1
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(k + 9, k) for k in range(1, 7)} <= {(d, i) for d, i, _ in expected}
    for most in (1 << 20, 0):  # one block; a shuffle join on seeds
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", most)
        got = Counter((r["doc_id"], r["item_id"], r["tiled_words"]) for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect())
        assert got == expected
        docs = docs_of(spark, [*rows, *ODD]).withColumnRenamed("source", "row")
        kept = decontaminate.drop_leaking(docs, bench)
        assert kept.columns == docs.columns
        leaking = {t for (d, t) in rows if any(slow_tiles(words(x), words(t), min(5, len(words(x)))) >= 0.5 * len(words(x)) for _, x in items)}
        assert Counter(r["text"] for r in kept.collect()) == Counter(t for _, t in [*rows, *ODD] if t not in leaking)


def test_leaks_are_found_reordered_and_clean_text_is_left(spark):
    rng = random.Random(4)
    item = [f"b{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "tiny item"), (3, None), (4, " ")], "item_id long, text string")
    noise = " ".join(prose(rng, 300))
    rows = [(10, noise), (11, f"{noise} {' '.join(item).upper()} {noise}"), (12, " ".join(item[20:] + ["x"] + item[:20])), (13, " ".join(item[:12])), (14, "a tiny item b"), *ODD]
    got = {(r["doc_id"], r["item_id"]): (r["coverage"], r["n_tiles"]) for r in decontaminate.find_leaks(docs_of(spark, rows), bench).collect()}
    assert got == {(11, 1): (1.0, 1), (12, 1): (1.0, 2), (14, 2): (1.0, 1)}
    kept = decontaminate.drop_leaking(docs_of(spark, rows), bench)
    assert kept.columns == docs_of(spark, rows).columns and kept.count() == len(rows) - 3
    assert decontaminate.find_leaks(docs_of(spark, rows), bench.limit(0)).count() == 0


# --- lines, shards -------------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [0, 1, 100_000])
def test_line_dedup_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(line_dedup, "HOT", hot)
    rng = random.Random(6)
    lines = ["short", "  A line that repeats  ", "a LINE that repeats", "unique one %d", "", "Zehn zeichen", "é" * 10]
    rows = [(100 - i, "\n".join((x % i if "%" in x else x) for x in rng.choices(lines, k=rng.randint(1, 8)))) for i in range(40)] + [(1, None), (2, "")]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    held = {}
    for d, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(d)
    expected = []
    for d, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        expected.append((d, len(own), len(own) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(docs_of(spark, rows)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(tuple(r) for r in got) == sorted(expected)
    own = docs_of(spark, rows).withColumnsRenamed({"lang": "N_lines", "source": "doc", "n_chars": "lost"})
    clashing = line_dedup.dedup_lines(own)
    assert clashing.columns == ["doc_id", "text", "N_lines_input", "doc", "lost", "n_lines", "n_dropped"]
    assert sorted(r["n_dropped"] for r in clashing.where("N_lines_input = 'en'").collect()) == sorted(e[2] for e in expected)
    assert line_dedup.dedup_lines(own, counts=False).columns == own.columns
    assert line_dedup.dedup_lines(docs_of(spark, ODD)).count() == len(ODD)
    assert line_dedup.dedup_lines(docs_of(spark, [])).count() == 0


def test_shards_are_near_equal_and_gapless(spark):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 3000)) for i in range(9000)] + ODD[:7]
    out = sharding.shard(docs_of(spark, rows), 16).collect()
    size, slots = Counter(), {}
    for r in out:
        size[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == len(rows) and max(size.values()) - min(size.values()) <= 0.01 * max(size.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[3]["text_crc32"] in (zlib.crc32(rows[3][1].encode()), zlib.crc32(ODD[3][1].encode()))
    assert all(r["size"] == len((dict(rows[:9000]).get(r["doc_id"]) or "").encode()) + 1 for r in out if (r["doc_id"] or 0) > 10)
    moved = sharding.rebalance(sharding.first_map(16), [1] * sharding.SLOTS, 17)
    assert max(Counter(moved).values()) - min(Counter(moved).values()) <= 1
    assert sharding.shard(docs_of(spark, [])).count() == 0


def test_later_runs_edit_the_stored_map(spark):
    rng = random.Random(17)
    path = new_path(spark, "map")
    rows = [(i, "x" * rng.randint(0, 300)) for i in range(5000)]
    first = {r["doc_id"]: r["shard"] for r in sharding.shard(docs_of(spark, rows), 8, path).collect()}
    version, before = sharding.load_map(spark, path)
    again = {r["doc_id"]: r["shard"] for r in sharding.shard(docs_of(spark, rows), 8, path).collect()}
    assert again == first and sharding.load_map(spark, path)[0] == version
    rows += [(9000 + i, "y" * 900) for i in range(400)]
    later = {r["doc_id"]: (r["shard"], r["virtual_slot"]) for r in sharding.shard(docs_of(spark, rows), 9, path, rows_per_group=1).collect()}
    newer, after = sharding.load_map(spark, path)
    assert newer == version + 1 and sharding.load_map(spark, path, version)[1] == before
    edited = {s for s in range(sharding.SLOTS) if before[s] != after[s]}
    assert all((shard != first[d]) == (slot in edited) for d, (shard, slot) in later.items() if d in first) and len(edited) < sharding.SLOTS / 2
    assert sharding.load_map(spark, path + "-none") is None


def test_one_id_for_all_rows(spark):
    rows = [(None, "same text of one hot key") for _ in range(300)] + [(7, f"text {i % 3} of seven words in all") for i in range(200)]
    out = sharding.shard(docs_of(spark, rows), 4, rows_per_group=20).collect()
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(out) == 500 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    got = Counter(tuple(r) for r in ngram_join.jaccard_components(docs_of(spark, rows)).collect())
    assert sum(got.values()) == 500 and {k[2] for k in got if k[0] == 7} == {7}


# --- toxicity ------------------------------------------------------------------------------------


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(8)
    terms = {t: False for t in ("grunt", "snarlish", "wobblerous", "mud", "grunts")}
    auto = toxicity.Automaton(terms)
    for _ in range(4000):
        w = list(rng.choice(list(terms)))
        for _ in range(rng.randint(0, 3)):
            at, kind = rng.randrange(len(w) + 1), rng.randint(0, 2)
            w[at : at + (kind > 0)] = rng.choice("grsunab") if kind < 2 else ""
        w = "".join(w)
        best = min(((d, t) for t in terms if (d := distance(w, t)) <= len(t) // toxicity.LETTERS_AN_ERROR), default=None)
        assert auto.match(w) == best, w
    stem = toxicity.Automaton({"grumf": True})
    assert stem.match("grumfenlich") == (0, "grumf") and stem.match("agrumfen") is None


def test_toxicity_learns_terms_and_spares_quotations(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(1200):
        w, toxic = prose(rng, 60), i % 4 == 0
        if toxic:
            w[rng.randrange(60)] = rng.choice(["snarlish", "grumble", "Wobblerous!"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    model = toxicity.fit(docs_of(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert set(model.terms) == {"snarlish", "grumble", "wobblerous"}
    tests = [(1, "you sn4rlish thing"), (2, "they are wobblreous"), (3, 'he said "snarlish" to them'), (4, "plain w1 w2 words"), (5, "snaaaarlish"), *ODD]
    own = docs_of(spark, tests).withColumnsRenamed({"lang": "Score", "source": "evidence"})
    out = toxicity.score(own, model)
    assert out.columns == ["doc_id", "text", "Score_input", "evidence_input", "n_chars", "score", "predicted", "evidence"]
    left = toxicity.drop_toxic(own, model)
    assert left.columns == own.columns and {r["text"] for r in left.where("Score = 'en'").collect()} == {tests[2][1], tests[3][1], *(t for _, t in ODD)}
    got = {r["text"]: r for r in out.collect()}
    assert [got[t]["predicted"] for _, t in tests[:5]] == [1, 1, 0, 0, 1]
    assert all(got[t]["predicted"] == 0 and 0 <= got[t]["score"] <= 1 for _, t in ODD)
    nothing = toxicity.fit(docs_of(spark, rows[:2]), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert toxicity.score(docs_of(spark, rows[:2]), nothing).where("predicted = 1").count() == 0


# --- perplexity ----------------------------------------------------------------------------------


def test_perplexity_equals_a_plain_model(spark):
    rng = random.Random(10)
    trusted = [" ".join(prose(rng, 40, 60)) for _ in range(80)]
    model = perplexity.train(spark.createDataFrame([(t,) for t in trusted], "text string"), size=30)
    tests = [*trusted[:5], "w1 w2 never seen words", "w1", "", None]
    got = {r["doc_id"]: r["log_ppl"] for r in perplexity.score(docs_of(spark, list(enumerate(tests))), model).collect()}
    kept = set(model.vocabulary.tolist())
    name = lambda w: w if int(word_hashes([w], lower=False)[0][0]) in kept else "<other>"
    counts, types = Counter(), {w for t in trusted for w in t.split()}
    for t in trusted:
        ws = ["<start>", *map(name, t.split())]
        counts.update(zip(ws, ws[1:]))
    others = len([w for w in types if name(w) == "<other>"]) + 1
    d = perplexity.discounts(*(sum(c == k for c in counts.values()) for k in range(1, 5)))
    follow = Counter(w for _, w in counts)
    dc = perplexity.discounts(*(sum(c == k for c in follow.values()) for k in range(1, 5)))
    total, spare = sum(follow.values()), sum(dc[min(c, 3)] for c in follow.values())

    def p(v, w):
        part = others if w == "<other>" else 1
        low = ((follow[w] - dc[min(follow[w], 3)]) / total + spare / total / 31) / part
        own = {y: c for (x, y), c in counts.items() if x == v}
        if not own:
            return low
        n = sum(own.values())
        return max(own.get(w, 0) - d[min(own.get(w, 0), 3)], 0) / n / part + sum(d[min(c, 3)] for c in own.values()) / n * low

    for i, t in enumerate(tests):
        ws = ["<start>", *map(name, (t or "").split())]
        if len(ws) == 1:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(-sum(math.log(p(a, b)) for a, b in zip(ws, ws[1:])) / (len(ws) - 1), rel=1e-6)


@pytest.mark.parametrize("frequent, texts, each", [(20, 120, 4), (200_000, 2100, 100)])
def test_no_word_type_is_merged(spark, monkeypatch, frequent, texts, each):
    monkeypatch.setattr(perplexity, "VOCABULARY", frequent)
    rng = random.Random(15)
    trusted = []
    for i in range(texts):
        ws = prose(rng, 20, 60) + [f"u{i}x{k}" for k in range(each)] + [f"twice{i // 2}"] * (i % 3)
        rng.shuffle(ws)
        trusted.append(" ".join(ws))
    model = perplexity.train(spark.createDataFrame([(t,) for t in trusted], "text string"))
    tests = [*trusted[:40], "w1 never u3x1", "u3x1 u3x2 w1", "never", "u2x0", ""]
    got = {r["doc_id"]: r["log_ppl"] for r in perplexity.score(docs_of(spark, list(enumerate(tests))), model).collect()}
    counts = Counter()
    for t in trusted:
        ws = ["<start>", *t.split()]
        counts.update(zip(ws, ws[1:]))
    d = perplexity.discounts(*(sum(c == k for c in counts.values()) for k in range(1, 5)))
    follow, n, free = Counter(w for _, w in counts), Counter(), Counter()
    for (v, _), c in counts.items():
        n[v] += c
        free[v] += d[min(c, 3)]
    dc = perplexity.discounts(*(sum(c == k for c in follow.values()) for k in range(1, 5)))
    total, spare = sum(follow.values()), sum(dc[min(c, 3)] for c in follow.values())
    assert len(follow) > frequent == len(model.vocabulary)

    def p(v, w):
        low = (follow[w] - dc[min(follow[w], 3)]) / total + spare / total / (len(follow) + 1)
        return (max(counts[v, w] - d[min(counts[v, w], 3)], 0) + free[v] * low) / n[v] if n[v] else low

    for i, t in enumerate(tests):
        ws = ["<start>", *t.split()]
        assert got[i] == (None if len(ws) == 1 else pytest.approx(-sum(math.log(p(a, b)) for a, b in zip(ws, ws[1:])) / (len(ws) - 1), rel=1e-6))


def test_quality_keeps_trusted_kinds_and_drops_noise(spark):
    rng = random.Random(11)
    rows = [(i, " ".join(prose(rng, 120, 300))) for i in range(1500)] + [(2000 + i, " ".join(f"Q{rng.random()}" for _ in range(100))) for i in range(50)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["kept"] for r in perplexity.classify(docs_of(spark, rows + [(3000, None), (3001, "")]), labels).collect()}
    assert not any(got[2000 + i] for i in range(50)) and sum(got[i] for i in range(1200, 1500)) >= 290 and got[3000] and got[3001]


# --- embeddings, licences ------------------------------------------------------------------------


def test_embeddings_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 16)
    rng = np.random.default_rng(12)
    rows = [(i, rng.standard_normal(32).tolist()) for i in range(700)]
    for i in range(60):
        x = np.array(rows[rng.integers(0, 20)][1])
        rows.append((900 + i, (x / np.linalg.norm(x) + 0.02 * rng.standard_normal(32)).tolist()))
    rows += [(2000, rows[3][1]), (2001, [2 * v for v in rows[3][1]]), (2002, None), (2003, [0.0] * 32), (2004, [float("nan")] * 32), (2005, [1.0, None]), (2006, []), (2007, [1.0, 2.0]), (None, rows[5][1]), (2000, rows[3][1])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    single = embed_dedup.near_duplicates(table.withColumn("embedding", F.col("embedding").cast("array<float>")))
    got = embed_dedup.near_duplicates(table).collect()
    assert len(single.collect()) == len(got) == single.distinct().count() + 1
    good = [(i, np.array(v)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n_links, found, pairs = Counter(), Counter({r["vec_id"]: 0 for r in got}), 0
    for i, (a, x) in enumerate(good):
        for b, y in good[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.95:
                n_links[a] += 1
                n_links[b] += 1
                pairs += 1
    for r in got:
        found[r["vec_id"]] += r["n_links"]
    assert len(got) == len(rows) and all(found[k] <= n_links[k] for k in found)
    assert sum(found.values()) >= 0.95 * 2 * pairs and pairs > 60
    by = {r["vec_id"]: r for r in got}
    assert by[2000]["component_id"] == 3 and not by[2000]["kept"] and by[2003]["kept"] and by[2002]["n_links"] == 0
    assert embed_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_licences_equal_brute_force(spark):
    lines = ["Licensed under the Apache License, Version 2.0.", "licensed under the apache license version 2.0", "This Work is licensed under the GNU General Public License, version 3!", "All rights reserved", "Some other text of the same length as a licence line", "All rights are reserved by nobody in particular here", "x", ""]
    rng = random.Random(13)
    rows = [(i, "\n".join(rng.choices(lines, k=6))) for i in range(30)] + ODD
    got = Counter((r["doc_id"], r["first_line"], r["licence"], round(r["dice"], 6)) for r in licenses.scan(docs_of(spark, rows)).where("passage = 'line'").collect())
    expected = Counter()
    for d, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            a = licenses.bigrams(line)
            best = max(((2 * len(a & b) / (len(a) + len(b)), name) for name, ts in licenses.TEMPLATES.items() for x in ts for b in [licenses.bigrams(x)]), key=lambda x: x[0])
            if a and best[0] >= licenses.LEAST_DICE:
                expected[d, n, best[1], round(best[0], 6)] += 1
    assert got == expected and got
    split = docs_of(spark, [(1, "intro\n\nThis work is licensed under the GNU\nGeneral Public License, version 3.\n\nend")])
    assert [(r["passage"], r["first_line"], r["n_lines"]) for r in licenses.scan(split).collect()] == [("paragraph", 2, 2), ("text", 0, 6)]


def test_licences_of_a_long_repeating_text(spark):
    """5,000 copies in one text, each found; and half a licence over and over, which is none."""
    index = licenses.Templates(licenses.TEMPLATES, licenses.LEAST_DICE)
    mit = licenses.TEMPLATES["MIT"][-1]
    before = time.process_time()
    found = index.windows(licenses._WORD.findall((mit + " ").lower() * 5000), {n for n, (name, _) in enumerate(index.all) if name == "MIT"})
    assert len({a for dice, _, a, _ in found if dice == 1}) == 5000
    half = max(licenses.TEMPLATES["GPL-3.0"], key=len).split()
    half = " ".join(half[: len(half) * 2 // 5]).lower()
    n = max(range(len(index.all)), key=lambda k: len(index.all[k][1]) * (index.all[k][0] == "GPL-3.0"))
    assert index.windows(licenses._WORD.findall((half + " ") * 300), {n}) == []
    assert time.process_time() - before < 60


def test_licences_inside_lines_and_across_them(spark):
    mit = licenses.TEMPLATES["MIT"][-1].split()
    block = "\n".join("# " + " ".join(mit[i : i + 9]) if i % 36 else "#" + "\n# " + " ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    rows = [
        (1, "See below. Copyright 2021 A. Author. Released under the MIT License. And more of it."),
        (2, "some prose comes first and then this work is licensed\nunder the GNU General Public License, version 3. It goes on\nfor a line more and another few words"),
        (3, f"x = 1\n{block}\ny = 2"),
        (4, "some words\n" + licenses.TEMPLATES["GPL-3.0"][2] + " and other words"),
        (5, "here This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License. " + "more words follow " * 5),
        (6, "the licence of the rights is reserved under a version " * 30),
    ]
    got = {}
    for r in licenses.scan(docs_of(spark, rows)).collect():
        got.setdefault(r["doc_id"], set()).add((r["licence"], r["first_line"]))
    assert got[1] == {("MIT", 0)} and got[2] == {("GPL-3.0", 0)} and got[5] == {("CC-BY-NC-4.0", 0)} and 6 not in got
    assert any(name == "MIT" for name, _ in got[3]) and ("GPL-3.0", 1) in got[4]


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_decisions_take_effect(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(14)
    item = " ".join(f"b{i}" for i in range(30))
    rows, labels = [], []
    for i in range(800):
        w, toxic = prose(rng, 80, 3000), i % 4 == 0
        if toxic:
            w[5] = "snarlish"
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    near = rows[1][1].split()
    near[40] = "changed"
    rows += [(1001, rows[1][1] + " "), (1002, " ".join(near)), (1003, f"{rows[2][1].upper()}x {item}"), (1004, "a line shared by both\n" + " ".join(prose(rng, 50, 3000))), (1005, "A line shared by both\n" + " ".join(prose(rng, 50, 3000))), *((i and i + 5000, t) for i, t in ODD)]
    docs_of(spark, rows).withColumns({c: F.lit("own") for c in ("score", "n_lines", "doc", "row", "node")}).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path))
        out = str(tmp_path / name.replace(" ", "-"))
        docs.write.parquet(out)
        docs = spark.read.parquet(out)
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != "best-fit packing":
            assert docs.columns == before.columns and docs.where("score = 'own' and n_lines = 'own' and doc = 'own'").count() == docs.count()
    toxic = {i for i in range(800) if i % 4 == 0}
    everything = {i for i, _ in rows}
    assert kept[0] == everything - toxic and kept[1] == kept[0]
    lines = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "line-dedup")).collect()}
    assert "shared by both" in lines[1004] and "shared by both" not in lines[1005]
    assert lines[1001] == ""  # the whole line is an earlier document's
    assert kept[2] == kept[1] - {1002} and kept[3] == kept[2] - {1003} and kept[4] == kept[3]
