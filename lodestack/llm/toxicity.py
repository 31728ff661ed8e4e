"""Toxicity by a lexicon trie and Levenshtein automata.

The lexicon is learned from labelled training rows: word beginnings that toxic documents hold and
others don't (in at least SUPPORT training rows and SHARE of the toxic ones, near copies counted
once), each grown to the longest beginning that still stands for the same documents, and whole words
of any length. A term that mostly is a whole word has to match whole words; a stem matches any word that begins with it.
All terms make one trie; the Levenshtein automata of all terms are run on it together, as sets of
(trie node, errors) states that are worked out when first met. A term allows an error for each
LETTERS_AN_ERROR letters, so misspelled terms are caught and short ones are not stretched.

Each hit looks at the words around it: between quotation marks, or close after a word of report,
it counts as a quotation and weighs QUOTED of a hit. The weights of misspelled hits and the score
of each level of evidence are learned from the training rows.

Training uses at most about TRAIN_ROWS labelled rows of each class, chosen by a hash of doc_id, and
never rows of the held-out part. All terms that these rows support are the lexicon: TRAIN_ROWS bounds
it, as a term needs SHARE of the toxic ones. Near copies are rows of one class that agree in SIGNS
min-hashes of their five-word shingles; the one of smallest doc_id is the witness.

Cases. Null, empty or blank text: no evidence, the score of a text without hits. A null doc_id is
scored as text is and belongs to no part (held_out false). Rows of one doc_id are scored each for
itself. Without labelled rows of both classes nothing is known and every score is 0. An empty table
gives no rows. Other columns take no part; those called score, predicted or evidence come out of
`score` as score_input and so on, and `drop_toxic` leaves all columns as they are.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import bloom
from lodestack.llm.common import column, fresh, hashed_texts, lean, materialise, mix, set_aside, shingle_hashes, table

TRAIN_ROWS, LETTERS_AN_ERROR, SIGNS = 6_000, 5, 4
SHORTEST, STEM, SUPPORT, SHARE, PURITY = 4, 16, 8, 0.01, 0.95  # STEM: letters of the longest stem
QUOTED, WINDOW, THRESHOLD = 0.2, 8, 0.3
#: Letters that stand for others in disguised words (fixed values).
_DISGUISE = str.maketrans("01345789@$!", "oieastbgasi")
#: Words after which something is reported rather than said (fixed values).
_REPORT = frozenset("said says saying wrote writes called calls quoted quotes quote cited dijo dice escribió sagte sagt schrieb dit disait écrit".split())
_OPEN, _CLOSE = '"“„«‹', '"”“»›'
_EDGES = ".,;:!?()[]{}<>*#%&$\"'“”„«»‹›`~|/\\_-=+…"


def fold(word: str) -> str:
    """A word as the lexicon has it: lower case, disguises undone, no drawn-out letters."""
    word = word.lower().strip(_EDGES)
    if not word.isalpha() and any(c.isalpha() for c in word):
        word = word.translate(_DISGUISE)
    if len(word) > 3:
        out = word[:2]
        for c in word[2:]:
            if not c == out[-1] == out[-2]:
                out += c
        word = out
    return word


class Automaton:
    """The Levenshtein automata of all terms on their trie, as one deterministic automaton whose
    states are made when met. `terms` maps a term to whether it is a stem."""

    MEMORY = 150_000  # (node, errors) pairs in all states, some 40 MB

    def __init__(self, terms: dict[str, bool]):
        self.kids: list[dict[str, int]] = [{}]
        self.ends: dict[int, tuple[str, bool, int]] = {}
        self.most = [0]
        for term, stem in sorted(terms.items()):
            at, allowed = 0, len(term) // LETTERS_AN_ERROR
            for c in term:
                self.most[at] = max(self.most[at], allowed)
                if c not in self.kids[at]:
                    self.kids[at][c] = len(self.kids)
                    self.kids.append({})
                    self.most.append(0)
                at = self.kids[at][c]
            self.most[at] = max(self.most[at], allowed)
            self.ends[at] = (term, stem, allowed)
        self._clear()

    def _clear(self) -> None:
        self.held = 0
        self.states: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.next: list[dict[str, int]] = []
        self.whole: list[tuple[int, str] | None] = []
        self.stem: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, now: dict[int, int]) -> int:
        todo = list(now.items())
        while todo:  # a letter of the term that the word leaves out
            node, e = todo.pop()
            for kid in self.kids[node].values():
                if e + 1 <= self.most[kid] and now.get(kid, 9) > e + 1:
                    now[kid] = e + 1
                    todo.append((kid, e + 1))
        key = frozenset(now.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.held += len(now) + 4
            self.sets.append(now)
            self.next.append({})
            hits = [(e, *self.ends[n]) for n, e in now.items() if n in self.ends and e <= self.ends[n][2]]
            self.whole.append(min(((e, t) for e, t, stem, _ in hits), default=None))
            self.stem.append(min(((e, t) for e, t, stem, _ in hits if stem and e <= len(t) // (LETTERS_AN_ERROR + 1)), default=None))
        return self.states[key]

    def _step(self, state: int, c: str) -> int:
        now: dict[int, int] = {}
        for node, e in self.sets[state].items():
            kid = self.kids[node].get(c)
            if kid is not None and now.get(kid, 9) > e:
                now[kid] = e
            if e + 1 <= self.most[node] and now.get(node, 9) > e + 1:
                now[node] = e + 1  # a letter too many
            for other in self.kids[node].values():
                if e + 1 <= self.most[other] and now.get(other, 9) > e + 1:
                    now[other] = e + 1  # another letter
        made = self._state(now) if now else -1
        self.next[state][c] = made
        return made

    def match(self, word: str) -> tuple[int, str] | None:
        """(errors, term) of the closest term, or None."""
        if self.held > self.MEMORY:
            self._clear()
        state, best = self.start, None
        for c in word:
            state = self.next[state].get(c, -2)
            if state == -2:
                return self._slow(word)
            if state == -1:
                return best
            if (hit := self.stem[state]) and (best is None or hit < best):
                best = hit
        hit = self.whole[state]
        return hit if hit and (best is None or hit < best) else best

    def _slow(self, word: str) -> tuple[int, str] | None:
        state, best = self.start, None
        for c in word:
            state = self.next[state][c] if c in self.next[state] else self._step(state, c)
            if state == -1:
                return best
            if (hit := self.stem[state]) and (best is None or hit < best):
                best = hit
        hit = self.whole[state]
        return hit if hit and (best is None or hit < best) else best


def _quoted(ws: list[str], at: int) -> bool:
    """Whether the word stands between quotation marks, or close after a word of report."""
    before, after = ws[max(0, at - WINDOW) : at], ws[at + 1 : at + 1 + WINDOW]
    own = ws[at]
    opened = own[:1] in _OPEN or any(w[:1] in _OPEN and w[-1:] not in _CLOSE for w in before)
    closed = own.rstrip(".,;:!?")[-1:] in _CLOSE or any(w.rstrip(".,;:!?")[-1:] in _CLOSE and w[:1] not in _OPEN for w in after)
    if own and opened and closed:
        return True
    return any(w.lower().strip(_EDGES) in _REPORT for w in before[-3:])


class Finder:
    """hits() of texts, with a bounded memory of words."""

    MEMORY = 60_000  # words

    def __init__(self, terms: dict[str, bool]):
        self.automaton = Automaton(terms)
        self.known: dict[str, tuple[int, str] | None] = {}

    def hits(self, text: str | None) -> list[tuple[str, int, bool]]:
        """(term, errors, quoted) of each hit in the whole text."""
        ws = text.split() if text else []
        known, out = self.known, []
        try:
            found = list(map(known.__getitem__, ws))
        except KeyError:
            if len(known) > self.MEMORY:
                known.clear()
            match = self.automaton.match
            for w in set(ws).difference(known):
                known[w] = match(fold(w))
            found = list(map(known.__getitem__, ws))
        if any(found):
            for at, hit in enumerate(found):
                if hit:
                    out.append((hit[1], hit[0], _quoted(ws, at)))
        return out


def _beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class the number of documents with a word beginning, or a whole word (ending in a space)."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}

    def told() -> pa.RecordBatch:
        rows = [(w, n, toxic) for toxic, c in counts.items() for w, n in c.items()]
        for c in counts.values():
            c.clear()
        return pa.RecordBatch.from_arrays([column([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int32()))], ["w", "n", "toxic"])

    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
            found, text = set(), text.as_py()
            for w in {fold(w) for w in (text or "").split()}:
                if len(w) >= SHORTEST:
                    found.update(w[:n] for n in range(SHORTEST, min(len(w), STEM) + 1))
                    found.add(w + " ")
            counts[toxic].update(found)
            if sum(map(len, counts.values())) > 100_000:
                yield told()
    yield told()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the SIGNS min-hashes of their text's five-word shingles; near copies mostly share them all."""
    for piece, texts in hashed_texts(batches):
        signs = []
        for h in texts:
            g, own = shingle_hashes(h, 5), []
            for _ in range(SIGNS):
                own.append(int(g.min()) if len(g) else 0)
                g = mix(g + np.uint64(1))
            signs.append(b"".join(x.to_bytes(8, "little") for x in own))
        yield pa.RecordBatch.from_arrays([*piece.columns, column(signs, pa.binary())], [*piece.schema.names, "signs"])


def _lexicon(counted: list[tuple[str, int, int]]) -> dict[str, bool]:
    """Terms from (beginning, toxic documents, other documents)."""
    toxic = {w: t for w, t, o in counted}
    good = {w for w, _, _ in counted if w[-1] != " "}
    kids: dict[str, list[str]] = {}
    for w in good:
        kids.setdefault(w[:-1], []).append(w)
    terms: dict[str, bool] = {}
    for w in sorted(w for w in good if w[:-1] not in good):  # the shortest beginnings
        while more := [x for x in kids.get(w, ()) if toxic[x] >= 0.9 * toxic[w]]:
            w = max(more)
        terms[w] = toxic.get(w + " ", 0) < 0.9 * toxic[w]
    for w in (w[:-1] for w in toxic if w[-1] == " "):  # whole words that no stem stands for
        if w not in terms and not any(terms.get(w[:n]) for n in range(SHORTEST, len(w))):
            terms[w] = False
    return terms


def _evidence_of(terms, misspelled, hits) -> float:
    """Full weight for clear hits, learned weights for misspelled ones; quotations add up to one QUOTED."""
    total, quoted = 0.0, 0.0
    for term, errors, is_quoted in hits:
        weight = 1.0 if not errors else misspelled.get((term, errors), 0.5)
        if is_quoted:
            quoted = max(quoted, QUOTED * weight)
        else:
            total += weight
    return total + quoted


LEVELS = (0.25, 0.45, 0.95, 1.95, 2.95)


class Model:
    def __init__(self, terms: dict[str, bool], misspelled: dict, scores: list[float]):
        self.terms, self.misspelled, self.scores = terms, misspelled, scores

    def score(self, hits) -> tuple[float, float]:
        evidence = _evidence_of(self.terms, self.misspelled, hits)
        level = int(np.searchsorted(LEVELS, evidence, "right"))
        low, high = self.scores[level], self.scores[level + 1]
        return low + (high - low) * (1 - math.exp(-evidence / 8)), evidence


def training_rows(docs: DataFrame, labels: DataFrame, rows_a_class: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text and toxic of labelled rows outside the held-out part, about `rows_a_class` of each class."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    ids = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(part != 2)
    n = {r["toxic"]: r["n"] for r in ids.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, rows_a_class / max(1, n.get(1, 0))).otherwise(rows_a_class / max(1, n.get(0, 0)))
    chosen = ids.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < share * 1_000_000)
    chosen = materialise(chosen.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"), "toxicity-labels")
    texts = bloom.among(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "doc_id", chosen.select("doc_id").distinct())
    return texts.join(chosen, "doc_id").select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, rows_a_class: int = TRAIN_ROWS) -> Model:
    rows = training_rows(docs, labels, rows_a_class).mapInArrow(lean(_signed), "doc_id long, text string, toxic int, signs binary")
    alone = rows.groupBy("toxic", "signs").agg(F.min_by("text", F.struct("doc_id", "text")).alias("text"))  # copies of one text are one witness
    train = materialise(alone.select("text", "toxic"), "toxicity-training")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model({}, {}, [0.0] * (len(LEVELS) + 2))
    counted = train.mapInArrow(lean(_beginnings), "w string, n long, toxic int").groupBy("w")
    counted = counted.agg(F.coalesce(F.sum(F.when(F.col("toxic") == 1, F.col("n"))), F.lit(0)).alias("t"), F.coalesce(F.sum(F.when(F.col("toxic") == 0, F.col("n"))), F.lit(0)).alias("o"))
    # A class may have more training rows than the other; count as if they were alike.
    even = sizes[1] / sizes[0]
    strong = counted.where(F.col("t") >= max(SUPPORT, SHARE * sizes[1])).where(F.col("t") >= PURITY * (F.col("t") + even * F.col("o")))
    terms = _lexicon([(r["w"], r["t"], int(even * r["o"])) for r in strong.collect()])  # the training rows bound it

    def facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(terms)
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hits = finder.hits(text)
                clear = any(not e and not q for _, e, q in hits)
                out += [(t, e, toxic) for t, e in {(t, e) for t, e, _ in hits if e}] if not clear else []
            yield pa.RecordBatch.from_arrays([column([r[0] for r in out], pa.string()), column([r[1] for r in out], pa.int32()), column([r[2] for r in out], pa.int32())], ["term", "errors", "toxic"])

    seen: dict = {}
    for r in train.mapInArrow(lean(facts), "term string, errors int, toxic int").groupBy("term", "errors", "toxic").agg(F.count("*").alias("n")).collect():
        seen.setdefault((r["term"], r["errors"]), [0, 0])[r["toxic"]] += r["n"]
    misspelled = {k: (t + 1) / (t + even * o + 2) for k, (o, t) in seen.items()}

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder, n = Finder(terms), Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n[int(np.searchsorted(LEVELS, _evidence_of(terms, misspelled, finder.hits(text)), "right")), toxic] += 1
        yield pa.RecordBatch.from_arrays([column([k[0] for k in n], pa.int32()), column([k[1] for k in n], pa.int32()), column(list(n.values()), pa.int64())], ["level", "toxic", "n"])

    found = np.zeros((len(LEVELS) + 1, 2))
    for r in train.mapInArrow(lean(levels), "level int, toxic int, n long").groupBy("level", "toxic").agg(F.sum("n").alias("n")).collect():
        found[r["level"], r["toxic"]] = r["n"] * (even if r["toxic"] == 0 else 1)
    prior = np.array([0.02, 0.15, 0.5, 0.8, 0.9, 0.95])  # weighs as much as four rows
    scores = (found[:, 1] + 4 * prior) / (found.sum(1) + 4)
    scores = np.maximum.accumulate(scores).tolist()
    return Model(terms, misspelled, [*scores, 1.0])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """`docs` with score (0 to 1), predicted, and evidence, the weight of the hits found."""
    docs = set_aside(docs, ["score", "predicted", "evidence"]).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.terms)
        for batch in batches:
            made = [model.score(finder.hits(t.as_py())) for t in batch.column("text")]
            scores = [s for s, _ in made]
            new = [column(scores, pa.float64()), column([int(s >= THRESHOLD) for s in scores], pa.int32()), column([e for _, e in made], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema.names)

    return docs.mapInArrow(lean(run), schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of `docs` that the model does not predict as toxic, every column as it is."""
    name = fresh(docs, "as_text")
    rows = docs.withColumn(name, F.col("text").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model.terms)
        for batch in batches:
            yield batch.filter(pa.array([model.score(finder.hits(t.as_py()))[0] < THRESHOLD for t in batch.column(name)], pa.bool_()))

    return rows.mapInArrow(lean(run), rows.schema).drop(name)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted")
