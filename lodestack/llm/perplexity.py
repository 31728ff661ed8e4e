"""Quality by perplexity under an interpolated modified Kneser-Ney bigram model.

The model is trained on trusted text: rows labelled of good quality and not toxic, all of them but
a tenth that is held out (by a hash of doc_id) for the thresholds. Words are as written, capitals
and punctuation included. Statistics cover all trusted rows and all their words: log P(w|v) is what
a word has without its bigram, log b(v) p(w), plus a gain where the bigram was seen. Words that were
never seen share one class. Every task has the probabilities and back-off weights of the VOCABULARY
most frequent words (ties by hash) as arrays and the gains of the FREQUENT most frequent bigrams.
Those of all other words, the rare ones, and of all other bigrams stay in shards by hash, are joined
there to the documents' words and bigrams and summed per document. What was never seen is mostly told
apart before that by a Bloom filter of bounded size, whose errors cost work only. A caller of `train`
may ask for a vocabulary of `size` words: all others then are the class, and a word of it has its
class's probability divided by the number of its word types.

A document is kept when its perplexity is at most the quantile QUANTILE of the held-out trusted
documents of its language and length band; a band with fewer than LEAST of these takes its
language's quantile, a language with fewer all held-out documents' of the band's length, such a band
with fewer that of all held-out documents, and without any everything is kept.

Cases. Null, empty or blank text: perplexity null, kept. A null lang is a language of its own. Rows
of one doc_id are scored each for itself; a null doc_id is carried. An empty table gives no rows.
Other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm import bloom
from lodestack.llm.common import column, discard, hashed_texts, lean, materialise, mix, signed, table, writing

VOCABULARY, QUANTILE, LEAST, HOLD_OUT = 200_000, 0.995, 100, 10
SHARD_BYTES = 32 << 20
FREQUENT = 500_000  # bigrams whose gains every task has, at most
BANDS = (16, 64, 256)
_BITS = np.uint64(18)  # of a word's place; the vocabulary and two more have to fit
_RARE = np.uint64(1 << 63)  # set in what names a rare word, 63 bits of its hash
_WORD, _LAST = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)
_OWNERS = {1: "<u1", 2: "<u2", 4: "<u4"}
GAINS_AT_ONCE = 200_000  # rows that a task packs at a time
FILTER_BITS = 1 << 27  # of the filter for what is in shards, at most: 16 MB
PACKED = "shard int, kind int, row long, doc_id long, lang string, n long, base double, data binary, rare binary"


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of a task's texts, summed up a few million words at a time."""
    waiting, size = [], 0

    def batch_of() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(waiting), return_counts=True)
        return pa.RecordBatch.from_arrays([column(signed(h), pa.int64()), column(n, pa.int64())], ["h", "n"])

    for _, texts in hashed_texts(batches, lower=False):
        waiting += texts
        size += sum(len(t) for t in texts)
        if size > 2_000_000:
            yield batch_of()
            waiting, size = [], 0
    if waiting:
        yield batch_of()


def _ids(h: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    """Places of hashes in the sorted vocabulary; its length for words outside it."""
    if not len(vocabulary):
        return np.zeros(len(h), np.int64)
    at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
    return np.where(vocabulary[at] == h, at, len(vocabulary)).astype(np.int64)


def _keys(ids: np.ndarray, start: int) -> np.ndarray:
    """A text's bigrams as numbers of 36 bits; its first word follows `start`, the word before all texts."""
    return (np.append(start, ids[:-1]).astype(np.uint64) << _BITS) | ids.astype(np.uint64)


def _named(h: np.ndarray, ids: np.ndarray, start: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts and words of a text's bigrams with a rare word (place `size`): places or names of rare words."""
    w = np.where(ids == size, h | _RARE, ids.astype(np.uint64))
    v = np.append(np.uint64(start), w[:-1])
    any_rare = (v | w) >= _RARE
    return v[any_rare], w[any_rare]


def _pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v) * np.uint64(0x9E3779B97F4A7C15) + w)


def _packed(keys: np.ndarray, beside: np.ndarray) -> bytes:
    """Keys in order and a number beside each, made small: steps from key to key, equal bytes of all
    numbers next to each other, compressed. The first byte says how wide the numbers beside are."""
    steps = np.diff(keys, prepend=np.uint64(0)).astype("<u8")
    planes = [x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in (steps, beside)]
    return bytes([beside.itemsize]) + pa.compress(b"".join(planes), "zstd", asbytes=True)


def _unpacked(data: bytes, n: int, kinds: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
    """Keys and numbers of `n` packed pairs; `kinds` has the type of numbers of each width."""
    width = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], (8 + width) * n, "zstd", asbytes=True), np.uint8)
    steps = np.ascontiguousarray(planes[: 8 * n].reshape(8, n).T).view("<u8").ravel()
    beside = np.ascontiguousarray(planes[8 * n :].reshape(width, n).T).view(kinds[width]).ravel()
    return np.cumsum(steps, dtype=np.uint64), beside


def _bigram_counts(vocabulary, whole: bool):
    """Bigrams of frequent words as one number and 0, others as what names their two words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, waiting, rare, size = vocabulary.value, [], [], 0

        def batch_of() -> pa.RecordBatch:
            k, n = np.unique(np.concatenate(waiting), return_counts=True)
            other = np.zeros(len(k), np.uint64)
            if rare:
                v, w = (np.concatenate([r[i] for r in rare]) for i in (0, 1))
                _, at, m = np.unique(_pair_keys(v, w), return_index=True, return_counts=True)
                k, other, n = np.append(k, v[at]), np.append(other, w[at]), np.append(n, m)
            return pa.RecordBatch.from_arrays([column(signed(k), pa.int64()), column(signed(other), pa.int64()), column(n, pa.int32())], ["key", "other", "n"])

        for _, texts in hashed_texts(batches, lower=False):
            for h in texts:
                if len(h):
                    ids = _ids(h, words)
                    keys = _keys(ids, len(words) + 1)
                    if whole and (ids == len(words)).any():
                        keys = keys[_inside(ids, len(words))]
                        rare.append(_named(h, ids, len(words) + 1, len(words)))
                    waiting.append(keys)
            size += sum(len(h) for h in texts)
            if size > 4_000_000 and waiting:
                yield batch_of()
                waiting, rare, size = [], [], 0
        if waiting:
            yield batch_of()

    return run


def _inside(ids: np.ndarray, size: int) -> np.ndarray:
    """Which bigrams of a text have frequent words only."""
    frequent = ids < size
    return frequent & np.append(True, frequent[:-1])


def discounts(n1: float, n2: float, n3: float, n4: float) -> np.ndarray:
    """Modified Kneser-Ney discounts of counts 0, 1, 2, and 3 or more."""
    if not n1:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n1 / (n1 + 2 * n2)
    made = [0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return np.array([0.0, *(min(max(d, 0.05), k - 0.05) for k, d in enumerate(made[1:], 1))])


def _numbers(df: DataFrame, size: int, key: str, names: list[str]) -> np.ndarray:
    """A table of at most `size` rows (words of the vocabulary) as arrays."""
    out = np.zeros((len(names), size))
    t = df.select(key, *names).toArrow()
    for i, n in enumerate(names):
        out[i, t.column(key).to_numpy()] = t.column(n).to_numpy()
    return out


def _gain(keys: np.ndarray, n: np.ndarray, fixed) -> np.ndarray:
    """What bigrams of frequent words, seen n times, add to what their words have without them."""
    p, backoff, c, d, types = fixed
    v, w = keys >> int(_BITS), keys & ((1 << int(_BITS)) - 1)
    share = np.where(w == len(p) - 1, types, 1)  # a word outside has its part of what its class has
    low = backoff[v] * p[w]
    return (np.log((n - d[np.minimum(n, 3)]) / c[v] / share + low) - np.log(low)).astype(np.float32)


class Model:
    """Arrays over frequent words and the class of others, gains of frequent bigrams, a filter for
    what is in shards, and the written table of that, packed by shard: other bigrams' counts (`fixed`
    makes gains of them), what rare words have beyond the class and the gains of their bigrams (none
    where `whole` is false)."""

    def __init__(self, vocabulary, log_p, log_b, frequent, seen: bloom.Bloom, gains: DataFrame, fixed, shards: int, whole: bool):
        self.vocabulary, self.log_p, self.log_b, self.frequent, self.seen, self.gains = vocabulary, log_p, log_b, frequent, seen, gains
        self.fixed, self.shards, self.whole = fixed, shards, whole


def _least_frequent(bigrams: DataFrame, most: int) -> int:
    """The count from which on bigrams are frequent: all of these are at most `most`."""
    step = F.least(F.col("n"), F.lit(10_000))
    total, least = 0, 10_001
    for r in bigrams.groupBy(step.alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("n")).collect():  # 10,000 rows at most
        total += r["rows"]
        if total > most:
            break
        least = r["n"]
    return least


def _bytes_in(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def train(trusted: DataFrame, size: int | None = None, to_score: int | None = None) -> Model:
    """The model of all rows of `trusted` (text), over all their words or the `size` most frequent.
    There are as many shards as `to_score` bytes of text ask for (those of `trusted` where not given)."""
    spark, whole = trusted.sparkSession, size is None
    shards = max(12, (_bytes_in(trusted) if to_score is None else to_score) // SHARD_BYTES)
    counted = materialise(trusted.mapInArrow(lean(_counts), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "word-counts")
    with writing(spark):
        top = counted.orderBy(F.col("n").desc(), "h").limit(VOCABULARY if whole else size).select("h").toArrow()  # that many numbers at most
    vocabulary = np.sort(top.column("h").to_numpy().view(np.uint64))
    outside = max(0, counted.count() - len(vocabulary))
    types = 1 if whole else outside + 1
    words = spark.sparkContext.broadcast(vocabulary)
    bigrams = trusted.mapInArrow(lean(_bigram_counts(words, whole)), "key long, other long, n int").groupBy("key", "other").agg(F.sum("n").alias("n"))
    bigrams = materialise(bigrams, "bigram-counts")
    common = (F.col("key") >= 0) & (F.col("other") >= 0)
    v = F.when(common, F.shiftright("key", int(_BITS))).otherwise(F.col("key"))
    w = F.when(common, F.col("key").bitwiseAND((1 << int(_BITS)) - 1)).otherwise(F.col("other"))
    v1 = len(vocabulary) + 1
    of = lambda k: F.sum(F.when(F.col("n") == k, 1).otherwise(0))
    n1, n2, n3, n4 = (x or 0 for x in bigrams.agg(*[of(k).alias(f"n{k}") for k in range(1, 5)]).first())
    d = discounts(n1, n2, n3, n4)
    # Continuation counts: in how many contexts a word was seen.
    follow = materialise(bigrams.groupBy(w.alias("w")).agg(F.count("*").alias("f")), "followers")
    seen_in = lambda k: F.sum(F.when(F.col("f") == k, 1).otherwise(0))
    *f, total = (x or 0 for x in follow.agg(*[seen_in(k).alias(f"f{k}") for k in range(1, 5)], F.sum(F.when(F.col("f") > 2, 1).otherwise(0)).alias("more"), F.sum("f").alias("total")).first())
    dc = discounts(*f[:4])
    spare = (dc[1] * f[0] + dc[2] * f[1] + dc[3] * f[4]) / total if total else 1.0
    spread = spare / (v1 + outside if whole else v1)

    def p_of(followers: np.ndarray) -> np.ndarray:
        return (followers - dc[np.minimum(followers, 3).astype(int)]) / max(total, 1) + spread

    [followers] = _numbers(follow.where("w >= 0"), v1, "w", ["f"])
    p = p_of(followers)
    p[-1] /= types
    by_context = bigrams.groupBy(v.alias("v")).agg(F.sum("n").alias("c"), of(1).alias("a"), of(2).alias("b"), F.sum(F.when(F.col("n") > 2, 1).otherwise(0)).alias("m"))
    by_context = materialise(by_context, "contexts")
    c, a, b, m = _numbers(by_context.where("v >= 0"), v1 + 1, "v", ["c", "a", "b", "m"])  # the last context is the start of a text
    backoff = np.where(c > 0, (d[1] * a + d[2] * b + d[3] * m) / np.maximum(c, 1), 1.0)
    log_p, log_b = np.log(p), np.log(backoff)
    fixed = spark.sparkContext.broadcast((p, backoff, c, d, types))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = _gain(batch.column("key").to_numpy(), batch.column("n").to_numpy(), fixed.value)
            yield pa.RecordBatch.from_arrays([batch.column("key"), column(gain, pa.float32())], ["key", "gain"])

    def own_backoff(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c, a, b, m = (batch.column(n).fill_null(0).to_numpy().astype(float) for n in ("c", "a", "b", "m"))
        return c, np.where(c > 0, (d[1] * a + d[2] * b + d[3] * m) / np.maximum(c, 1), 1.0)

    def rare_gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, backoff, c, d, _ = fixed.value
        for batch in batches:
            v, w, n = (batch.column(k).to_numpy() for k in ("key", "other", "n"))
            own_c, own_b = own_backoff(batch)
            at = np.maximum(v, 0)
            n_v, b_v = np.where(v < 0, own_c, c[at]), np.where(v < 0, own_b, backoff[at])
            low = b_v * np.where(w < 0, p_of(batch.column("f").fill_null(0).to_numpy()), p[np.maximum(w, 0)])
            gain = np.log((n - d[np.minimum(n, 3)]) / n_v + low) - np.log(low)
            yield pa.RecordBatch.from_arrays([column(signed(_pair_keys(v.view(np.uint64), w.view(np.uint64))), pa.int64()), column(gain.astype(np.float32), pa.float32())], ["key", "gain"])

    def rare_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a rare word has beyond the class, and what it has too much where no word follows."""
        for batch in batches:
            name = batch.column("w").to_numpy().view(np.uint64)
            weight = np.log(own_backoff(batch)[1])
            beyond = np.log(p_of(batch.column("f").to_numpy())) - np.log(fixed.value[0][-1]) + weight
            keys, gain = np.append(mix(name + _WORD), mix(name + _LAST)), np.append(beyond, -weight)
            yield pa.RecordBatch.from_arrays([column(signed(keys), pa.int64()), column(gain.astype(np.float32), pa.float32())], ["key", "gain"])

    def rare_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, w = (batch.column(k).to_numpy().view(np.uint64) for k in ("key", "other"))
            yield pa.RecordBatch.from_arrays([column(signed(_pair_keys(v, w)), pa.int64())], ["key"])

    def word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            name = batch.column("w").to_numpy().view(np.uint64)
            yield pa.RecordBatch.from_arrays([column(signed(np.append(mix(name + _WORD), mix(name + _LAST))), pa.int64())], ["key"])

    frequent_only, others = bigrams.where(common).select("key", "n"), bigrams.where(~common)
    least = _least_frequent(frequent_only, FREQUENT)
    top = frequent_only.where(F.col("n") >= least).mapInArrow(lean(gains), "key long, gain float").toArrow()  # FREQUENT rows at most
    order = np.argsort(top.column("key").to_numpy())
    frequent = top.column("key").to_numpy()[order].view(np.uint64), top.column("gain").to_numpy()[order]
    rest = frequent_only.where(F.col("n") < least)
    # Only rare words are joined, so no key has more rows than a rare word has bigrams.
    rare_f, rare_c = follow.where("w < 0"), by_context.where("v < 0")
    of_v = F.col("key") == F.col("v")
    of_w = F.col("other") == F.col("w")
    none = lambda *names: {n: F.lit(None).cast("long") for n in names}
    columns = ["key", "other", "n", "c", "a", "b", "m", "f"]
    both = others.where("key < 0 and other < 0").join(rare_c, of_v).join(rare_f, of_w).select(*columns)
    first = others.where("key < 0 and other >= 0").join(rare_c, of_v).withColumns(none("f")).select(*columns)
    second = others.where("key >= 0").join(rare_f, of_w).withColumns(none("c", "a", "b", "m")).select(*columns)
    rare = both.unionByName(first).unionByName(second).mapInArrow(lean(rare_gains), "key long, gain float")
    rare = rare.unionByName(rare_f.join(rare_c, F.col("w") == F.col("v"), "left").mapInArrow(lean(rare_words), "key long, gain float"))
    keys = rest.select("key").unionByName(others.select("key", "other").mapInArrow(lean(rare_keys), "key long")).unionByName(rare_f.select("w").mapInArrow(lean(word_keys), "key long"))
    seen = bloom.build(keys, rest.count() + others.count() + 2 * rare_f.count(), FILTER_BITS)
    packed = rest.mapInArrow(lean(_packed_gains(shards, False)), PACKED)
    if whole:
        packed = packed.unionByName(rare.mapInArrow(lean(_packed_gains(shards, True)), PACKED))
    packed = materialise(packed, "gains")
    for written in (counted, bigrams, follow, by_context):
        discard(written)
    return Model(vocabulary, log_p, log_b, frequent, seen, packed, fixed, shards, whole)


def _scored(shared, shards: int):
    """One row per document with what it has without bigrams, and by shard the bigrams and rare words
    of a slice of documents: keys in order, and for each the place of its document in the slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, log_p, log_b, (top, gains), seen, whole = shared.value
        for piece, texts in hashed_texts(batches, most=1 << 21, lower=False):
            columns: list[list] = [[] for _ in range(9)]
            waiting: tuple[list, list] = [], []

            def put(*row) -> None:
                for held, x in zip(columns, row):
                    held.append(x)

            rows = piece.column("row").to_numpy()  # numbers in a row, as they were given out
            for k, (doc, lang, h) in enumerate(zip(*(piece.column(n).to_pylist() for n in ("doc_id", "lang")), texts)):
                row = int(rows[k])
                if not len(h):
                    put(row % shards, 1, row, doc, lang, 0, 0.0, None, None)
                    continue
                ids = _ids(h, vocabulary)
                base = log_p[ids].sum() + log_b[ids[:-1]].sum() + log_b[-1]
                keys = _keys(ids, len(vocabulary) + 1)
                outside = h[ids == len(vocabulary)] | _RARE if whole else h[:0]
                if len(outside):
                    keys = keys[_inside(ids, len(vocabulary))]
                    own = [mix(outside + _WORD), _pair_keys(*_named(h, ids, len(vocabulary) + 1, len(vocabulary)))]
                    if ids[-1] == len(vocabulary):
                        own.append(mix(outside[-1:] + _LAST))
                    waiting[1].extend((x, k) for x in own)
                if len(top):
                    at = np.minimum(np.searchsorted(top, keys), len(top) - 1)
                    known = top[at] == keys
                    base += gains[at[known]].sum(dtype=np.float64)
                    keys = keys[~known]
                put(row % shards, 1, row, doc, lang, len(ids), float(base), None, None)
                waiting[0].append((keys, k))
            for rare, held in enumerate(waiting):
                if not held:
                    continue
                keys, owner = np.concatenate([x for x, _ in held]), np.repeat([k for _, k in held], [len(x) for x, _ in held])
                maybe = seen.holds(keys)
                keys, owner = keys[maybe], owner[maybe]
                to = (mix(keys) >> np.uint64(8)) % np.uint64(shards)
                order = np.lexsort((keys, to))
                keys, to, owner = keys[order], to[order], owner[order].astype(_OWNERS[1 if piece.num_rows <= 1 << 8 else 2 if piece.num_rows <= 1 << 16 else 4])
                at = np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else []
                for s, e in zip(at, [*at[1:], len(keys)]):
                    data = _packed(keys[s:e], owner[s:e])
                    put(int(to[s]), 1, int(rows[0]), None, None, int(e - s), None, None if rare else data, data if rare else None)
            yield pa.RecordBatch.from_arrays(
                [column(x, t) for x, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.binary(), pa.binary()))],
                ["shard", "kind", "row", "doc_id", "lang", "n", "base", "data", "rare"],
            )

    return run


def _packed_gains(shards: int, rare: bool):
    """By shard the keys and gains of rare words and their bigrams, or the keys and counts of other bigrams."""

    def rows_of(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        keys = t.column("key").to_numpy().view(np.uint64)
        gain = t.column("gain").to_numpy().astype("<f4") if rare else t.column("n").to_numpy().astype("<i8")
        to = ((mix(keys) >> np.uint64(8)) % np.uint64(shards)).astype(np.int32)
        order = np.lexsort((keys, to))
        keys, gain, to = keys[order], gain[order], to[order]
        at = np.flatnonzero(np.append(True, to[1:] != to[:-1]))
        ends = np.append(at[1:], len(to))
        none = lambda t: pa.nulls(len(at), t)
        data = [column([_packed(keys[s:e], gain[s:e]) for s, e in zip(at, ends)], pa.binary()), none(pa.binary())]
        return pa.RecordBatch.from_arrays(
            [column(to[at], pa.int32()), column(np.zeros(len(at), np.int32), pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.string()), column(ends - at, pa.int64()), none(pa.float64()), *(data[::-1] if rare else data)],
            ["shard", "kind", "row", "doc_id", "lang", "n", "base", "data", "rare"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= GAINS_AT_ONCE:
                yield rows_of(held)
                held, size = [], 0
        if held:
            yield rows_of(held)

    return run


def _gained(fixed):
    """Per document and shard the sum of gains. Input: by shard, a shard's gains before its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, parts, held = None, ([], []), [None, None]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.float64())
        for batch in batches:
            out = []
            for s, kind, row, doc, lang, n, base, data, rare in zip(*(c.to_pylist() for c in batch.columns)):
                if s != shard:
                    shard, parts, held = s, ([], []), [None, None]
                if kind == 0:
                    if data is None:
                        parts[1].append(_unpacked(rare, n, {4: "<f4"}))
                    else:
                        keys, seen = _unpacked(data, n, {8: "<i8"})
                        parts[0].append((keys, _gain(keys.view(np.int64), seen, fixed.value)))
                    continue
                for k, found in enumerate(parts):
                    if found:
                        keys, gains = np.concatenate([p[0] for p in found]), np.concatenate([p[1] for p in found])
                        order = np.argsort(keys)
                        held[k] = keys[order], gains[order]
                        found.clear()
                if data is None and rare is None:
                    out.append((row, doc, lang, n, base))
                elif held[data is None] is not None:
                    keys, gains = held[data is None]
                    own, owner = _unpacked(rare if data is None else data, n, _OWNERS)
                    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                    known = keys[at] == own
                    sums = np.bincount(owner[known], gains[at[known]].astype(np.float64))
                    out += [(row + int(k), None, None, None, float(sums[k])) for k in np.flatnonzero(sums)]
            yield pa.RecordBatch.from_arrays([column([r[i] for r in out], t) for i, t in enumerate(kinds)], ["row", "doc_id", "lang", "n", "log_p"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_words and log_ppl (null without words) of every row of `docs`."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    shards = model.shards
    shared = spark.sparkContext.broadcast((model.vocabulary, model.log_p, model.log_b, model.frequent, model.seen, model.whole))
    sent = docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(lean(_scored(shared, shards)), PACKED)
    parts = sent.unionByName(model.gains).repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(lean(_gained(model.fixed)), "row long, doc_id long, lang string, n long, log_p double")
    whole = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("lang").alias("lang"), F.max("n").alias("n_words"), F.sum("log_p").alias("log_p"))
    return whole.select("doc_id", "lang", "n_words", F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words")).alias("log_ppl"))


def _held_out():
    return F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(HOLD_OUT)) == 0


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, size: int | None = None) -> DataFrame:
    """doc_id, lang, n_words, perplexity, limit and kept of every row of `docs`."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    good = materialise(good, "trusted-ids")
    trusted = bloom.among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", good)
    model = train(trusted.where(~_held_out()).select("text"), size, _bytes_in(docs))
    scored = materialise(score(docs, model), "perplexities")
    band = F.lit(len(BANDS))
    for k in range(len(BANDS) - 1, -1, -1):
        band = F.when(F.col("n_words") < BANDS[k], k).otherwise(band)
    scored = scored.withColumn("band", band).withColumn("language", F.coalesce("lang", F.lit("")))
    tests = scored.where("log_ppl is not null").join(good.where(_held_out()), "doc_id", "left_semi")
    q = F.percentile_approx("log_ppl", quantile, 10_000).alias("q")
    limit = lambda keys, name: tests.groupBy(*keys).agg(F.count("*").alias("n"), q).where(F.col("n") >= LEAST).select(*keys, F.col("q").alias(name))
    # Languages times bands: small tables, joined as Spark sees fit.
    out = scored.join(limit(["language", "band"], "own"), ["language", "band"], "left").join(limit(["language"], "of_language"), "language", "left")
    out = out.join(limit(["band"], "of_band"), "band", "left")
    of_all = tests.agg(q).first()["q"]
    top = F.coalesce("own", "of_language", "of_band", F.lit(of_all).cast("double"))
    return out.select(
        "doc_id", "lang", "n_words", F.exp("log_ppl").alias("perplexity"), F.exp(top).alias("limit"),
        F.coalesce(F.col("log_ppl") <= top, F.lit(True)).alias("kept"),
    )


def op6_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
