import hashlib
import math
import random

import numpy as np
import pytest
from lodestack.llm import vector_codes
from lodestack.llm.vector_codes import KdTree, product_codes, squares

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    """Plain Python over lists of rows (vec_id, vector, label)."""
    kept = [(i, [math.floor(1024 * x) for x in e], y) for i, e, y in rows if e and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4
    cut = [[e[p * w : (p + 1) * w] for p in range(4)] for _, e, _ in kept]
    books = [[c[p] for c in cut[:256]] for p in range(4)]

    def near(q, book):
        return min((sum((a - b) ** 2 for a, b in zip(q, e)), k) for k, e in enumerate(book))

    for _ in range(4):
        for p in range(4):
            who = [near(c[p], books[p])[1] for c in cut]
            for k in range(len(books[p])):
                own = [c[p] for c, n in zip(cut, who) if n == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    found = [[near(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for (_, _, y), e in zip(kept, errors):
        labels[y] = labels.get(y, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, "".join(f"{k:02x}" for _, k in f), e, labels[y], digest) for (i, _, y), f, e in zip(kept, found, errors))


def coded(spark, rows, schema=SCHEMA):
    return sorted(tuple(r) for r in product_codes(spark.createDataFrame(rows, schema).repartition(3)).collect())


def rows_of(n, seed, width=8):
    rng = random.Random(seed)
    # a coarse grid: many equal distances, and repeated vectors
    return [(i, [rng.randint(-3, 3) / 2 + 0.0005 for _ in range(width)], rng.choice([None, 1, 2])) for i in range(n)]


def test_equals_plain_code(spark):
    rows = rows_of(400, 5)
    bad = [(900, None, 1), (901, [], 1), (902, [1.0, None] + [0.0] * 6, 1), (903, [float("nan")] + [0.0] * 7, None), (-5, [float("-inf")] + [0.0] * 7, 2)]
    assert coded(spark, rows + bad) == brute(rows + bad)


def test_few_vectors_repeated_rows(spark):
    rows = [(3, [1.0] * 4, None), (3, [1.0] * 4, None), (1, [-0.25, 0.5, 2.0, 1.0], 7)]
    assert coded(spark, rows) == brute(rows)


def test_null_id_comes_last(spark):
    got = {r["vec_id"]: r["code"] for r in product_codes(spark.createDataFrame([(None, [1.0] * 4, 1), (2, [0.0] * 4, 1)], SCHEMA)).collect()}
    assert got == {2: "00000000", None: "01010101"}


def test_empty_and_extra_columns(spark):
    assert product_codes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert product_codes(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    rows = [(i, e, y, "x", 5) for i, e, y in rows_of(20, 2)]
    got = product_codes(spark.createDataFrame(rows, SCHEMA + ", code string, error int"))
    assert sorted(tuple(r) for r in got.collect()) == brute([r[:3] for r in rows])


def test_many_and_hot_labels(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "LABELS", 1)
    monkeypatch.setattr(vector_codes, "HOT", 20)
    rows = [(i, e, None if i % 3 == 0 else i % 40) for i, e, _ in rows_of(150, 9)]
    assert coded(spark, rows) == brute(rows)


def test_wrong_lengths(spark):
    with pytest.raises(Exception, match="one length"):
        product_codes(spark.createDataFrame([(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)], SCHEMA)).count()
    with pytest.raises(Exception, match="4 divides"):
        product_codes(spark.createDataFrame([(1, [1.0] * 6, 1)], SCHEMA)).count()


def test_tree_visits_equal_bounds():
    rng = np.random.default_rng(3)
    entries = rng.integers(-4, 5, (256, 3))
    entries[40:60] = entries[10:30]
    q = rng.integers(-6, 7, (3000, 3))
    who, away = KdTree(entries).nearest(q)
    all_away = squares(q, entries)
    assert (away == all_away.min(1)).all() and (who == all_away.argmin(1)).all()


def test_squares_are_exact():
    rng = np.random.default_rng(4)
    q, e = rng.integers(-(2**29), 2**29, (20, 4)), rng.integers(-(2**29), 2**29, (9, 4))
    assert squares(q, e).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in e] for x in q]
