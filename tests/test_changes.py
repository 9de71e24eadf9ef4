"""Transactions that write what changes, records that outlive a restart, activity."""

import random

import pytest

from weirlog import reports, session as sessions, telemetry
from weirlog.plans.check import program_of
from weirlog.session import Session
from weirlog.sources import layers, shared
from weirlog.streaming.feed import Feed
from weirlog.types import RuleError
from weirlog.worlds import World, Worlds

RULES = """
road(X,Y) :- link(X,Y), !shut(X,_). road(X,Y) :- link(Y,X), both(X).
trip(X,Y) :- road(X,Y). trip(X,Z) :- trip(X,Y), road(Y,Z).
even(X) :- start(X). odd(Y) :- even(X), road(X,Y). even(Y) :- odd(X), road(X,Y).
lost(X) :- start(X), !trip(X,_). calm(X) :- start(X), !shut(_,9). near(X,Y) :- trip(X,Y), X < Y, !lost(Y).
"""
SCHEMAS = reports.relations(link_="int int", shut_="int int", both_="int", start_="int", road="int int", trip="int int", even="int", odd="int", lost="int", calm="int", near="int int")


def plain(facts):
    """All derived relations by brute force over sets."""
    link, shut, both, start = (facts[n] for n in ("link", "shut", "both", "start"))
    road = {(x, y) for x, y in link if not any(a == x for a, _ in shut)} | {(x, y) for y, x in link if (x,) in both}
    trip = set(road)
    while more := {(a, d) for a, b in trip for c, d in road if b == c} - trip:
        trip |= more
    even, odd = {x for (x,) in start}, set()
    while True:
        new = ({y for x, y in road if x in even} - odd, {y for x, y in road if x in odd} - even)
        if not any(new):
            break
        odd, even = odd | new[0], even | new[1]
    lost = {x for (x,) in start if not any(a == x for a, _ in trip)}
    return {"road": road, "trip": trip, "even": {(x,) for x in even}, "odd": {(x,) for x in odd}, "lost": {(x,) for x in lost}, "calm": set(start) if not any(b == 9 for _, b in shut) else set(), "near": {(x, y) for x, y in trip if x < y and y not in lost}}


def test_random_transactions(spark, monkeypatch):
    """Insertions and deletions below negation and recursion; deltas are exactly what differs. Small limits make layers be rewritten."""
    monkeypatch.setattr(layers, "LEAST", 6)
    monkeypatch.setattr(sessions, "KEPT", 2)
    rng, one = random.Random(7), Session(spark)
    one.install(RULES, SCHEMAS)
    facts = {"link": set(), "shut": set(), "both": set(), "start": set()}
    was = plain(facts)
    for step in range(3):
        changes = []
        for name, arity, n in (("link", 2, 12 if not step else 3), ("shut", 2, 1), ("both", 1, 1), ("start", 1, 2)):
            for _ in range(n):
                gone = rng.random() < 0.45 and facts[name]
                fact = rng.choice(sorted(facts[name])) if gone else tuple(rng.randint(0, 9) for _ in range(arity))
                changes.append(reports.change("delete" if gone else "insert", name, *fact))
                (facts[name].discard if gone else facts[name].add)(fact)
        done, now = one.apply(changes), plain(facts)
        assert {r: set(one.rows(r)) for r in now} == now
        for r in now:
            told = {tuple(x) for x in done.deltas[r].collect()} if r in done.deltas else set()
            assert told == {(*x, 1) for x in now[r] - was[r]} | {(*x, -1) for x in was[r] - now[r]}
        was = now


def test_a_small_change_writes_small_tables(spark, monkeypatch):
    """One link at the end of a chain: nothing of the size of the inputs or results is written again, and old tables go."""
    monkeypatch.setattr(sessions, "KEPT", 2)
    one = Session(spark)
    one.install("trip(X,Y) :- link(X,Y). trip(X,Z) :- trip(X,Y), link(Y,Z).", reports.relations(link_="int int", trip="int int"))
    one.load({"link": spark.range(12).selectExpr("id AS f0", "id + 1 AS f1").union(spark.range(1000, 6000).selectExpr("id * 10 AS f0", "id * 10 + 1 AS f1"))})
    size = one.count_rows("trip")
    with shared.recorded() as paths:
        done = one.apply([reports.change("insert", "link", 12, 13)])
    assert paths == [] and done.deltas["trip"].count() == 13 and one.count_rows("trip") == size + 13
    first = one.tables[-1][0]
    assert max(spark.read.parquet(p).count() for p in one.tables[-1]) <= 13 < size
    done = one.apply([reports.change("delete", "link", 6, 7)])
    assert done.deltas["trip"].count() == 7 * 7 and max(spark.read.parquet(p).count() for p in one.tables[-1]) < 1000
    for i in range(sessions.KEPT + 1):
        one.apply([reports.change("insert", "link", -i - 5, -i - 500)])
    assert one.count_rows("trip") == size + 13 - 49 + sessions.KEPT + 1 and all(first not in t for t in one.tables)


def test_a_failure_leaves_the_session(spark, monkeypatch):
    one = Session(spark)
    one.install(*reports.OPEN)
    one.apply([reports.change("insert", "nation", 1, 1)])
    monkeypatch.setattr(sessions.Strata, "of", lambda self, stratum: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        one.apply([reports.change("insert", "nation", 2, 2)])
    assert one.rows("open") == [(1, 1)] and one.revision == 2 and one.health == "healthy"
    monkeypatch.undo()
    world = World(spark, "w", lambda s: s.install(*reports.OPEN))
    generation = world.start()
    monkeypatch.setattr(world.session, "apply_without_deltas", lambda changes: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        world.admit("k", generation, 1, [])
    assert world.admission_status("k")["state"] == "uncertain" and world.state == "failed" and world.session.health == "failed"


def test_feed_keys_outlive_a_restart(spark):
    from weirlog.sources import checkpoint

    one, other = Session(spark), Session(spark)
    one.install(*reports.OPEN)
    batch = lambda *f: spark.createDataFrame([("insert", *f)], "op string, f0 long, f1 long")
    Feed(one, "nation").apply(batch(1, 1), 0)
    checkpoint.restore_value(other, checkpoint.checkpoint_value(one))
    feed = Feed(other, "nation")
    feed.apply(batch(2, 2), 0)
    assert other.rows("open") == [(1, 1)]
    feed.apply(batch(2, 2), 1)
    assert other.rows("open") == [(1, 1), (2, 2)]


def test_names_are_reserved(spark, tmp_path):
    first = Worlds(spark, tmp_path)
    first.create("a", lambda s: s.install(*reports.OPEN))
    second = Worlds(spark, tmp_path)
    for wrong in ("a", "../b"):
        with pytest.raises(RuleError):
            second.create(wrong, lambda s: None)
    assert second.open("a", lambda s: s.install(*reports.OPEN)).start() == 1 and second.lineage("a") is None
    with pytest.raises(RuleError, match="Unknown world"):
        second.open("c", lambda s: None)


def test_groups_of_a_graph(spark):
    one = Session(spark)
    one.install(RULES, SCHEMAS)
    whole = telemetry.graph(one)
    assert {"from": "shut", "to": "road", "kinds": ["negative"]} in whole["edges"] and whole["nodes"]["trip"]["rules"] == 2
    found = telemetry.grouped(whole, "^(even|odd)$|^(x)$")
    assert set(found["nodes"]) == set(whole["nodes"])
    both = telemetry.grouped(whole, "^(?:even|odd|near)$|^l")
    assert both["nodes"]["l"]["relations"] == ["link", "lost"] and all(e["from"] != e["to"] for e in both["edges"])
    assert sorted(telemetry.near(whole, ["calm"])["nodes"]) == ["calm", "shut", "start"]
    for wrong in (lambda: telemetry.grouped(whole, "("), lambda: telemetry.near(whole, ["none"])):
        with pytest.raises(RuleError):
            wrong()
    assert program_of(RULES, SCHEMAS).recursive(("even", "odd"))
