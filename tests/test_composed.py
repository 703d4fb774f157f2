"""Rules of composed questions that the star schema does not exercise, against small graphs."""

from __future__ import annotations

import math
import random

import pytest

from tessera.operators import closure, composed, decide, spatial

NODE = "id string, name string, type string, kind string, lat double, lon double, start_date string, end_date string"
EDGE = "source string, target string, type string, family string, count long, start_date string, end_date string, point_date string, event_start string, event_end string, ord long"


def graph(spark, edges):
    rows = [(s, t, r, None, n, None, None, None, None, None, i) for i, (s, r, t, n) in enumerate(edges)]
    roles = [(r, r, False) for r in ("acted_at", "event_link", "occurred_at", "part_of", "located_in", "weak")]
    return composed.role_links(spark.createDataFrame(rows, EDGE), spark.createDataFrame(roles, "type string, role string, inverse boolean"))


def nodes(spark, rows):
    return spark.createDataFrame([(i, n, t, k, p, p, None, None) for i, n, t, k, p in rows], NODE)


def test_profile_rules(spark):
    known = nodes(spark, [
        ("u", "Unit", "org", None, None), ("v", "Sub", "org", None, None), ("b", "Battle", "event", "battle", None), ("c", "Campaign", "event", None, 7.0), ("w", "World War", "event", None, None),
        ("h", "Hub", "event", None, None), ("s1", "S1", "event", None, 1.0), ("s2", "S2", "event", None, 2.0), ("x", "Port", "location", None, 3.0), ("y", "Bay", "location", None, 4.0), ("z", "Ship", "other", None, None),
    ])
    links = graph(spark, [
        ("u", "event_link", "b", 5), ("u", "event_link", "w", 9), ("u", "event_link", "h", 9), ("v", "part_of", "u", 2), ("u", "part_of", "v", 1), ("v", "event_link", "c", 3), ("v", "acted_at", "x", 4), ("v", "acted_at", "z", 4),
        ("b", "occurred_at", "x", 2), ("w", "occurred_at", "y", 9), ("s1", "part_of", "h", 1), ("s2", "part_of", "h", 1), ("y", "weak", "u", 3),
    ])
    start = spark.createDataFrame([("u",), ("w",), ("h",)], "id string")
    got = {(r["root"], r["loc"]): (r["strength"], r["hops"], r["paths"], r["via"]) for r in composed.connected_locations(composed.profile_paths(start, links, known, hub=1)).collect()}
    assert got == {("u", "x"): (2, 2, 2, "b"), ("u", "c"): (2, 2, 1, "v"), ("h", "s1"): (1, 1, 1, None), ("h", "s2"): (1, 1, 1, None)}
    weak = composed.profile_paths(start, links, known, hub=1, weak=3).filter("loc = 'y'").collect()
    assert [(r["root"], r["strength"]) for r in weak] == [("u", 3)]


def test_profiles_are_summed_without_listing_paths(spark):
    """Random graphs of all roles, with cycles, sub-events, hubs, wars and own points: the same rows as
    those of the listed paths."""
    rng = random.Random(1)
    rows = [(f"o{i}", "Unit", "org", None, None) for i in range(6)] + [(f"p{i}", "Person", "person", None, None) for i in range(3)] + [(f"x{i}", "Thing", "other", None, rng.choice([None, 1.0])) for i in range(4)]
    rows += [(f"e{i}", rng.choice(["Battle", "Raid", "World War"]), "event", None, rng.choice([None, 2.0])) for i in range(12)] + [(f"l{i}", "Place", "location", None, 3.0) for i in range(5)]
    ids = {t: [r[0] for r in rows if r[2] == t] for t in ("org", "person", "other", "event", "location")}
    actors, spots = ids["org"] + ids["person"] + ids["other"], ids["location"] + ids["other"]
    pick = lambda a, role, b, n: [(rng.choice(a), role, rng.choice(b), rng.randint(1, 4)) for _ in range(n)]
    edges = pick(ids["org"] + ids["other"], "part_of", ids["org"] + ids["other"], 8) + pick(ids["event"], "part_of", ids["event"], 10) + pick(actors, "event_link", ids["event"], 40)
    edges += pick(ids["event"], "occurred_at", spots, 8) + pick(actors, "acted_at", spots, 8) + pick(ids["location"], "located_in", ids["location"], 4) + pick(actors, "weak", ids["location"], 6)
    known, links = nodes(spark, rows), graph(spark, edges)
    starts = known.select("id")
    listed = composed.connected_locations(composed.profile_paths(starts, links, known, hub=2, weak=2))
    summed = composed.profile_locations(starts, links, known, hub=2, weak=2)
    assert summed.columns == listed.columns
    assert sorted(map(repr, summed.collect())) == sorted(map(repr, listed.collect())) != []


def test_closures_run_to_the_end(spark):
    chain = spark.createDataFrame([(f"{i + 1:03d}", f"{i:03d}") for i in range(40)], "child string, parent string")
    assert closure.closure(chain, spark.createDataFrame([("000",)], "id string")).count() == 41
    redirects = spark.createDataFrame([(f"t{i:02d}", f"t{i + 1:02d}") for i in range(20)] + [("a", "b"), ("b", "a"), ("c", "a")], "title string, target string")
    got = {r["title"]: r["target"] for r in closure.resolve_redirects(redirects).collect()}
    assert got == {f"t{i:02d}": "t20" for i in range(20)} | {"a": "b", "b": "a", "c": "a"}


def test_near_join_equals_brute_force(spark):
    rng = random.Random(1)
    points = [(i, rng.choice([rng.uniform(-90, 90), 89.9, -89.5, 0.0]), rng.choice([rng.uniform(-180, 180), 179.9, -180.0, 180.0])) for i in range(150)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1, math.sqrt(h)))

    for reach in (50.0, 700.0, 4000.0):
        got = sorted((r["id"], r["other"]) for r in spatial.near_join(df, df, reach).collect())
        assert got == sorted((a[0], b[0]) for a in points for b in points if km(a, b) <= reach)


def test_data_limits(spark):
    rows = nodes(spark, [("Q1", "Q1", "event", None, None), ("a", "Place", "location", None, None), ("b", "Thing", "other", None, 1.0)])
    got = {r["id"]: r["limits"] for r in composed.data_limits(rows).collect()}
    assert got == {"Q1": ["name_is_id", "no_text", "no_dates"], "a": ["no_text", "no_geometry"], "b": ["no_text", "type_unresolved"]}


def test_running_sums_and_ranks_with_ties_and_nulls(spark):
    """A frequent score, null scores and text keys: the same ranks as one ordered list."""
    rows = [(i, 5.0 if i % 3 == 0 else None if i % 10 == 1 else float(i * 37 % 101)) for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, score double")
    ranked = {r.id: r.ensemble for r in decide.rank_average(frame, ["score"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[0]))
    assert ranked == pytest.approx({i: place / 1999 for place, (i, _) in enumerate(order)})

    words = spark.createDataFrame([(f"w{i * 7919 % 500:03d}", i) for i in range(500)], "word string, n long")
    got = [(r.word, r.before_n, r.all_n) for r in decide.running(words, "word", ["n"]).orderBy("word").collect()]
    ahead = 0
    for (word, before, whole), (expected, n) in zip(got, sorted((r.word, r.n) for r in words.collect()), strict=True):
        assert (word, before, whole) == (expected, ahead, sum(range(500)))
        ahead += n

    empty = decide.rank_average(frame.limit(0), ["score"])
    assert empty.count() == 0
