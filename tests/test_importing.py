"""The import of reference records against a plain one-by-one import."""

import random

from lodestack.operators import importing

RECORDS = "seq long, source_id string, record_id string, location string, title string, platform string, region string, edition string, dump_set string"
EDITIONS = "id long, game_id long, platform string, region string, edition string"
CLAIMS = "release_id long, source_id string, location string, field string, qualifier string, value string, seq long"
SETS = "source_id string, record_id string, release_id long, dump_set string"
ITEMS = "source_id string, record_id string, release_id long, evidence string, candidates array<long>, status string"


class Plain:
    """One record after the other, on lists."""

    def __init__(self, editions=(), claims=(), sets=(), items=()):
        self.editions = {e[0]: e for e in editions}
        self.claims = {(r, s, f, q, v): (loc, seq) for r, s, loc, f, q, v, seq in claims}
        self.sets = {(s, r): (e, d) for s, r, e, d in sets}
        self.items = {(s, r): (e, ev, list(c), st) for s, r, e, ev, c, st in items}

    def claim(self, release, source, location, field, qualifier, value, seq):
        self.claims[release, source, field, qualifier, value] = (location, seq)

    def place(self, e):
        return tuple(x.strip().lower() for x in self.editions[e][2:])

    def evidence(self, source, title, place, dumps):
        found = {e for (s, _), (e, d) in self.sets.items() if dumps and d == dumps and s != source and self.place(e) == place}
        kind = "sha1" if found else "title"
        if not found:
            found = {e for e, s, f, q, v in self.claims if (f, q) == ("title", "") and v.strip().lower() == title and s != source and self.place(e) == place}
        free = sorted(e for e in found if not any((r, s, f, q) == (e, source, "identifier", "source_record") for r, s, f, q, _ in self.claims))
        return kind, len(found), free

    def revalidate(self, source, record, release, title, place, dumps):
        item = self.items.get((source, record))
        if item is None:
            if (release, source, "identifier", "linked_by", "sha1") not in self.claims:
                return
            item = (release, "", [], "linked")
        kind, _, free = self.evidence(source, title, place, dumps)
        if item[3] != "pending" and not [c for c in free if c != item[0] and c not in item[2]]:
            return
        if not free:
            self.items.pop((source, record), None)
        else:
            self.items[source, record] = (release, kind, free, "pending")

    def peers(self, source, release, dumps):
        for (s, r), (e, d) in list(self.sets.items()):
            if d == dumps and s != source and self.place(e) == self.place(release):
                titles = [(seq, v) for (e2, s2, f, q, v), (_, seq) in self.claims.items() if (e2, s2, f, q) == (e, s, "title", "")]
                self.revalidate(s, r, e, max(titles)[1].strip().lower() if titles else "", self.place(e), dumps)

    def dumped(self, source, record, release, dumps):
        before = self.sets.get((source, record), (None, None))[1]
        if dumps:
            self.sets[source, record] = (release, dumps)
        else:
            self.sets.pop((source, record), None)
        if before and before != dumps:
            self.peers(source, release, before)
        if dumps:
            self.peers(source, release, dumps)

    def add(self, seq, source, record, location, title, platform, region, edition, dumps):
        title_key, place = title.strip().lower(), tuple(x.strip().lower() for x in (platform, region, edition))

        def assertions(release):
            self.claim(release, source, location, "title", "", title, seq)
            self.claim(release, source, location, "identifier", "source_record", record, seq)

        known = [e for e, s, f, q, v in self.claims if (s, f, q, v) == (source, "identifier", "source_record", record)]
        if known:
            release = min(known)
            assertions(release)
            for e, s, f, q, v in list(self.claims):
                if (e, s, f, q) == (release, source, "identifier", "linked_by"):
                    self.claim(e, s, location, f, q, v, seq)
            self.dumped(source, record, release, dumps)
            self.revalidate(source, record, release, title_key, place, dumps)
            return release, "known"
        kind, n, free = self.evidence(source, title_key, place, dumps)
        if n == 1 and len(free) == 1:
            assertions(free[0])
            self.claim(free[0], source, location, "identifier", "linked_by", kind, seq)
            self.dumped(source, record, free[0], dumps)
            return free[0], "linked"
        named = sorted(((s != source, e) for e, s, f, q, v in self.claims if (f, q) == ("title", "") and v.strip().lower() == title_key and self.place(e)[0] == place[0]))
        game = next((g for g in (self.editions[e][1] for _, e in named) if not any(self.editions[e][1] == g and self.place(e) == place and s != source for e, s, *_ in self.claims)), seq)
        same = [e for e, row in self.editions.items() if row[1] == game and self.place(e) == place]
        release = same[0] if same else seq
        if not same:
            self.editions[seq] = (seq, game, platform, region, edition)
        assertions(release)
        self.dumped(source, record, release, dumps)
        if free:
            self.items[source, record] = (release, kind, free, "pending")
        return release, "joined" if same else "founded"

    def tables(self):
        return {
            "editions": sorted(self.editions.values()),
            "claims": sorted((r, s, loc, f, q, v, seq) for (r, s, f, q, v), (loc, seq) in self.claims.items()),
            "sets": sorted((s, r, e, d) for (s, r), (e, d) in self.sets.items()),
            "items": sorted((s, r, *x) for (s, r), x in self.items.items()),
        }


def batch(rng, n, first=1000):
    rows = []
    for k in range(n):
        title = rng.choice(["Quest", " quest ", "Quest II", "Twin", "Solo"])
        rows.append((first + k, f"s{rng.randrange(4)}", f"r{rng.randrange(12)}", f"f{k}", title, rng.choice(["GB", "gb", "PS"]), rng.choice(["USA", "Europe"]), "Standard", rng.choice([None, "a", "b", "c"])))
    return rows


def run(spark, plain, rows, parts=3):
    old = plain.tables()
    frames = [spark.createDataFrame(old[n], s) for n, s in (("editions", EDITIONS), ("claims", CLAIMS), ("sets", SETS), ("items", ITEMS))]
    records = spark.createDataFrame(rows, RECORDS).repartition(parts)
    return importing.reference_import(*frames, records)


def compared(got, plain, placed):
    assert {r["seq"]: (r["release_id"], r["outcome"]) for r in got["placed"].collect()} == placed
    for name, want in plain.tables().items():
        assert sorted(map(tuple, got[name].collect())) == want, name


def test_batch_equals_one_by_one(spark):
    rng = random.Random(1)
    rows = batch(rng, 60)
    plain = Plain()
    placed = {r[0]: plain.add(*r) for r in rows}
    got = run(spark, Plain(), rng.sample(rows, len(rows)))
    compared(got, plain, placed)
    assert {o for _, o in placed.values()} >= {"known", "linked", "founded"}


def test_batch_on_a_catalog_with_decided_reviews(spark):
    rng = random.Random(11)
    plain = Plain()
    for r in batch(rng, 50):
        plain.add(*r)
    for k, (key, item) in enumerate(sorted(plain.items.items())):
        plain.items[key] = (*item[:3], ["pending", "kept_apart", "linked"][k % 3])
    before = Plain()
    before.__dict__.update({n: dict(v) for n, v in plain.__dict__.items()})
    rows = batch(rng, 40, 2000)
    got = run(spark, before, rng.sample(rows, len(rows)), 5)
    compared(got, plain, {r[0]: plain.add(*r) for r in rows})


def test_many_records_of_one_title(spark):
    """A title that all records share: the chain of links is found in a few rounds."""
    rows = [(100 + k, f"s{k}", "r", "f", "Hot", "GB", "USA", "Standard", None) for k in range(40)]
    plain = Plain()
    placed = {r[0]: plain.add(*r) for r in rows}
    compared(run(spark, Plain(), rows[::-1]), plain, placed)
    assert {e for e, _ in placed.values()} == {100}


def test_empty(spark):
    got = run(spark, Plain(), [])
    assert all(got[n].count() == 0 for n in got)


def test_empty_catalog_is_known_to_the_planner(spark, sf):
    from lodestack.plans import changes
    from lodestack.plans.bridge import relation

    for df in changes._import(relation(spark, sf, "release_editions"))[:3]:
        assert "LocalRelation <empty>" in df._jdf.queryExecution().optimizedPlan().toString().splitlines()[0]


def test_dump_sets_are_asked_once_a_source_and_moment(spark, monkeypatch):
    """Thirty records of two sources with one dump set and titles of their own: each import judges all of the other source again."""
    rows = [(100 + k, f"s{k % 2}", f"r{k}", "f", f"T{k}", "GB", "USA", "Standard", "a") for k in range(30)]
    sizes, written = {}, importing.written

    def counted(df, name):
        out = written(df, name)
        sizes.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(importing, "written", counted)
    plain = Plain()
    placed = {r[0]: plain.add(*r) for r in rows}
    compared(run(spark, Plain(), rows[::-1]), plain, placed)
    assert sizes["asked-again"] == [225] and sizes["questions"] == [29, 0]
