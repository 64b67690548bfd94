"""Subsets of notes of equally many lines are sought together; what is found is what is found for each."""

import random

import numpy as np
import pandas as pd
import pytest

from tallyspark.operators import recon

LINES = "numero long, seq int, cfop string, cents long"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 9, 12, 16])
def test_together_as_alone(n):
    r = random.Random(n)
    values = [[r.randrange(-3, 9) if k % 2 else r.randrange(1, 10**9) for _ in range(n)] for k in range(30)]
    targets = [r.choice([10**12, 0, sum(r.sample(v, r.randint(1, n)))]) for v in values]
    got = recon.first_subsets(np.array(values, np.int64), np.array(targets, np.int64))
    assert got == [recon.first_subset(v, t) for v, t in zip(values, targets, strict=True)]


def test_notes_of_a_batch_are_sought_together(monkeypatch):
    monkeypatch.setattr(recon, "TRIED", 100)  # a few notes at a time
    r = random.Random(1)
    notes = [None if k % 5 == 0 else np.array([r.randrange(1, 40) for _ in range(r.randrange(6, 20))]) for k in range(100)]
    targets = [None if v is None else int(sum(v[2:5])) if k % 3 else 10**6 for k, v in enumerate(notes)]
    want = [None if v is None else recon.first_subset(v.tolist(), t) for v, t in zip(notes, targets, strict=True)]
    alone, search = [], recon.first_subset
    monkeypatch.setattr(recon, "first_subset", lambda v, t: alone.append(len(v)) or search(v, t))
    made = recon._search.func(iter([(pd.Series(notes, dtype=object), pd.Series(targets)), (pd.Series([None], dtype=object), pd.Series([None])), (pd.Series([], dtype=object), pd.Series([], dtype="int64"))]))
    assert [x.tolist() for x in made] == [want, [None], []]
    assert sorted(alone) == sorted(len(v) for v in notes if v is not None and len(v) > recon.AT_ONCE)  # every note before


def test_odd_lines(spark):
    """Null numbers, codes and amounts, lines that come twice, notes of no lines on one side."""
    a = [(None, 1, "x", 5), (1, 1, None, 7), (1, 2, "y", 7), (2, 1, "x", None), (2, 2, "x", 3), *[(3, i % 4, "x", 2) for i in range(8)], (4, 1, "x", 9), (5, None, "x", 4), (5, 1, "y", 6)]
    b = [(None, 1, "x", 5), (1, 1, "y", 14), (2, 1, "x", 3), (3, 1, "x", 6), (5, 1, "x", 6), (5, None, "y", 4), (6, 1, "x", 1)]
    got = sorted((tuple(r) for r in recon.pair_notes(spark.createDataFrame(a, LINES), spark.createDataFrame(b, LINES)).collect()), key=repr)
    want = [
        (None, "so_a", 1, None, False), (None, "so_b", None, 1, False), (1, "casada", 1, 1, None), (2, "revisar", None, None, False), (3, "casada", 0, 1, False), *[(3, "so_a", s, None, False) for s in (1, 2, 2, 3, 3)],
        (4, "so_a", 1, None, False), (5, "casada", None, None, True), (5, "casada", 1, 1, True), (6, "so_b", None, 1, False),
    ]
    assert got == sorted(want, key=repr)


def test_totals_and_subsets_are_not_interpreted(spark):
    pairs = recon.pair_notes(*(spark.createDataFrame([(1, 1, "x", 5)], LINES),) * 2)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "array_sort(" not in plan


def test_lines_by_number(spark):
    rows = [(1, 2, "x", 5), (1, None, "x", 1), (1, 2, None, 7), (1, 2, "x", 5), (None, 1, "x", 3), (2, 1, "x", None), (2, 2, "x", 4)]
    got = {r.numero: ([tuple(x) for x in r.l], r.s) for r in recon.by_number(spark.createDataFrame(rows, LINES), "l", "s").collect()}
    assert got == {1: ([(None, "x", 1), (2, None, 7), (2, "x", 5), (2, "x", 5)], 18), None: ([(1, "x", 3)], 3), 2: ([(1, "x", None), (2, "x", 4)], None)}
