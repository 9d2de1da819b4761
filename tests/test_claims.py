"""Ordered claims on a graph of names against rows that come one by one."""

import random

import pytest

from plotlink.operators import linkage


def brute(rows, offers):
    taken, claims, of = set(), set(), {}
    for c, name, mid in offers:
        of.setdefault((c, name), set()).add(mid)
    for c, name, key, _ in sorted(rows, key=lambda r: (r[0], r[3])):
        free = [m for m in of.get((c, name), ()) if (c, m) not in taken]
        if len(free) == 1:
            taken.add((c, free[0]))
            claims.add((c, key, free[0]))
    return claims


def claimed(spark, rows, offers, monkeypatch):
    """The claims and how many rounds they took."""
    n = []
    monkeypatch.setattr(linkage, "_undisputed", lambda *a, f=linkage._undisputed: n.append(1) or f(*a))
    got = linkage.claims_of_names(spark.createDataFrame(rows, "cem_id int, name string, key long, ord long"), spark.createDataFrame(offers, "cem_id int, name string, mid long"))
    return {tuple(r) for r in got.collect()}, len(n)


@pytest.mark.parametrize("seed", [1, 2])
def test_claims_equal_rows_one_by_one(spark, seed, monkeypatch):
    rng = random.Random(seed)
    rows, offers, key = [], [], 0
    for cem in range(6):
        names = [f"n{i}" for i in range(14)]
        for i, n in enumerate(names):
            offers += [(cem, n, m) for m in rng.sample(range(cem * 100, cem * 100 + 16), rng.choice([1, 1, 2, 2, 3]))]
        for o in range(60):
            rows.append((cem, rng.choice(names), key, o * 3))
            key += 1
    got, rounds = claimed(spark, rows, offers, monkeypatch)
    assert got == brute(rows, offers) and len(got) > 20 and rounds <= 10


def test_rounds_do_not_follow_the_rows_of_a_name(spark, monkeypatch):
    # a thousand dateless rows of one name whose two memorials a married name shares, and some names beside them
    offers = [(1, "smith ann", 1), (1, "smith ann", 2), (1, "jones ann", 1), (1, "lee bo", 5), (1, "lee bo", 6), (1, "ray bo", 6)]
    rows = [(1, "smith ann", i, i) for i in range(1000) if i != 700] + [(1, "jones ann", 700, 700), (1, "ray bo", 5000, 2), (1, "lee bo", 5001, 1), (1, "lee bo", 5002, 4000)]
    got, rounds = claimed(spark, rows, offers, monkeypatch)
    assert got == brute(rows, offers) == {(1, 700, 1), (1, 701, 2), (1, 5000, 6), (1, 5002, 5)}
    assert rounds <= 3
