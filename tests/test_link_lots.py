"""Lots are laid out for pairs of one block alone; the links stay those of all pairs."""

import random

from pyspark.sql import functions as F

from plotlink import config as C
from plotlink.operators import linkage as lk

COLS = "cem_id int, ord long, {} long, nl string, sx string, nm string, cf string, fr string, by int, dy int, dyb boolean, section string, block string, lot string"


def _frame(spark, rows, key):
    return spark.createDataFrame([(c, i, i + 1, *r) for i, (c, *r) in enumerate(rows)], COLS.format(key))


def test_lots_of_a_name_do_not_meet_each_other(spark, monkeypatch):
    rows = [(1, "ASH", "A200", "", "JOHN", "JOHN", 1850, 1900, False, "A", "B", str(i)) for i in range(1, 101)]
    seen, scored = [], lk.scored_profiles

    def spy(*a, **k):
        out = scored(*a, **k)
        seen.append(out.count())
        return out

    monkeypatch.setattr(lk, "scored_profiles", spy)
    got = lk.link_register_memorial(_frame(spark, rows, "key"), _frame(spark, rows, "mid")).collect()
    assert {(r.key, r.mid) for r in got} == {(i, i) for i in range(1, 101)}
    assert seen == [1]


def test_best_of_candidates_is_best_of_all_pairs(spark):
    rng = random.Random(3)

    def rows(n):
        pick = rng.choice
        return [(pick([1, 2]), *pick([("ASH", "A200"), ("ASHE", "A200"), ("OAK", "O200"), ("", "")]), pick(["", "", "OAK", "ASH"]),
                 *pick([("JOHN", "JOHN"), ("JACK", "JACK"), ("", ""), ("J", "J")]), pick([0, 1850, 1851, 1860]), pick([0, 1900, 1901]), pick([True, False]),
                 pick(["A", "A", "B", "", "*", None]), pick(["C", "D", "", None]), pick(["1", "01", "2", "3b", "", None])) for _ in range(n)]

    register, memorial = _frame(spark, rows(250), "key"), _frame(spark, rows(300), "mid")
    prof, other = lk.profiles(register, "r", "key"), lk.profiles(memorial, "m", "mid")
    by = ["cem_id", "r_ord"]
    want = lk.best_two(lk.score_pairs(register, memorial), by, "m_mid", "m_n", lk._rank_tier(), "m_ord").collect()
    got = lk.best_two(lk.candidates(prof, other, C.LINK_MAYBE), by, "m_mid", "m_n", F.col("tier"), "m_ord").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 100
