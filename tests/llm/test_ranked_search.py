import math
import random
import re

import numpy as np
from lodestack.llm import ranked_search
from lodestack.llm.ranked_search import bisected, search, terms_of

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    own = [(i, terms(t)) for i, t in docs]
    n_docs, length = sum(bool(t) for _, t in own), sum(len(t) for _, t in own)
    df = {}
    for _, t in own:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    rows = []
    for item, text in items:
        scores = []
        for i, t in own:
            s = 0
            for w in set(terms(text)) & set(t):
                tf, m = t.count(w), 10 + 90 * len(t) * n_docs // length
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * tf // (1000 * tf + 8 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0))
        rows += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scores)[:10])]
    return sorted(rows, key=repr)


def found(spark, docs, items, docs_schema=DOCS, items_schema=ITEMS):
    got = search(spark.createDataFrame(docs, docs_schema).repartition(3), spark.createDataFrame(items, items_schema))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted((tuple(r) for r in got.collect()), key=repr)


def corpus(n, seed, vocabulary=150):
    rng = random.Random(seed)
    docs = []
    for i in range(n):
        topic = rng.randrange(4)
        docs.append((i, " ".join(f"T{topic}w{int(rng.paretovariate(0.8)) % vocabulary}" for _ in range(rng.randint(1, 40)))))
    return docs + [(n + k, docs[3][1]) for k in range(n // 3)]  # a third are copies: ties


ODD = [(None, "t0w1 t1w2"), (None, None), (5000, None), (5001, ""), (5002, "... -- !"), (5003, "t0W1"), (5003, "t0W1"), (5004, "T1w2 " * 30_000), (5005, "Ünï·t0w1 ÄÖ éa")]


def queries(n, seed):
    rng = random.Random(seed)
    items = [(k, " ".join(f"t{rng.randrange(5)}w{rng.randrange(40)}" for _ in range(rng.randint(1, 25)))) for k in range(n)]
    return items + [(n, None), (n + 1, ""), (n + 2, "nothing of this"), (None, "t0w1"), (n + 3, "ünï äö Ünï ÄÖ")]


def test_terms():
    for t in ["Ab1-c_D\x00é\x7fÀ z", "", None, "日本 x·y", "A" * 10]:
        assert [b.decode() for b in terms_of(t)] == terms(t)


def test_equals_plain_code_in_one_segment(spark):
    docs, items = corpus(300, 1) + ODD, queries(30, 2)
    assert found(spark, docs, items) == brute(docs, items)


def test_equals_plain_code_in_many_segments(spark, monkeypatch):
    for name, value in (("SEGMENT", 40), ("CLUSTER", 8), ("SAMPLE", 1024), ("WAVES", (2, 5))):
        monkeypatch.setattr(ranked_search, name, value)
    docs, items = corpus(700, 3) + ODD, queries(25, 4)
    assert found(spark, docs, items) == brute(docs, items)


def test_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "BLOCK_BYTES", 3 * ranked_search.ITEM_BYTES)
    docs, items = corpus(60, 5), queries(5, 6)
    assert found(spark, docs, items) == brute(docs, items)


def test_empty_and_clashing(spark):
    docs, items = corpus(30, 7), queries(3, 8)
    assert found(spark, [], items) == [] and found(spark, docs, []) == [] and found(spark, [(1, None)], items) == []
    wide = [(i, t, 1, "x", 2) for i, t in docs]
    assert found(spark, wide, [(i, t, 0) for i, t in items], DOCS + ", score int, item_id string, n long", ITEMS + ", rank int") == brute(docs, items)
    assert found(spark, docs, items + items[:1]) == brute(docs, items + items[:1])


def test_order_keeps_like_documents_together():
    rng = np.random.default_rng(1)
    topic = rng.integers(0, 4, 512)
    doc = np.repeat(np.arange(512), 10)
    term = topic[doc] * 50 + rng.integers(0, 50, len(doc))
    order = bisected(doc, term, 512, 32)
    assert sorted(order.tolist()) == list(range(512))
    pure = [np.bincount(topic[order[a : a + 32]], minlength=4).max() / 32 for a in range(0, 512, 32)]
    assert np.mean(pure) > 0.8


def test_clusters_of_low_bounds_are_left_out():
    """Term k is in cluster k only; ids fall while places rise."""
    k = np.arange(8, dtype=np.int32)
    rows = {"group_term": k, "group_cluster": k, "group_most": np.full(8, 5), "group_start": np.arange(0, 1001, 125, dtype=np.int32)}
    rows |= {"place": np.arange(1000, dtype=np.int32), "impact": np.full(1000, 5), "ids": np.arange(1000)[::-1].copy()}
    segment = ranked_search.Segment({"segment": 0} | {c: v.tobytes() for c, v in rows.items()})
    _, bound = segment.bounds(np.array([2, 9]))
    assert bound.tolist() == [0, 0, 5, 0, 0, 0, 0, 0]
    assert segment.best(np.array([2]), 1) == [(-5, i) for i in range(625, 635)]
    assert segment.best(np.array([2]), 6) == []
