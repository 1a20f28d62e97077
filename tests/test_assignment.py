"""The queue of matches against the rule itself, row by row."""

from __future__ import annotations

import random
import re

import pytest

from paragrid.operators import assignment


def by_the_rule(left, right, length=30, least=10):
    out = []
    norm = lambda t: re.sub(r"\s+", " ", t or "").strip()
    for doc in {d for d, _, _ in left}:
        texts, used = {}, set()
        for _, i, t in sorted((r for r in right if r[0] == doc), key=lambda r: r[1]):
            texts.setdefault(norm(t), []).append(i)
        texts.pop("", None)
        for _, i, t in sorted((r for r in left if r[0] == doc), key=lambda r: r[1]):
            t = norm(t)
            options = [("exact", texts.get(t, []))] if t else []
            if len(t) >= least:
                options += [("prefix", places) for other, places in texts.items() if other.startswith(t[:length])]
            for kind, places in options:
                free = [p for p in places if p not in used]
                if free:
                    best = min(free, key=lambda p: abs(p - i))
                    used.add(best)
                    out.append((doc, i, best, kind))
                    break
    return sorted(out)


def found(spark, left, right):
    sides = [spark.createDataFrame(x, "doc_id int, idx int, text string") for x in (left, right)]
    return sorted(map(tuple, assignment.find_matches(*sides).collect()))


def test_nearest_free():
    r = random.Random(1)
    for _ in range(300):
        places = sorted(r.sample(range(30), r.randint(0, 12)))
        wanted, free, want = [r.randint(0, 30) for _ in range(r.randint(0, 14))], list(places), []
        for w in wanted:
            want.append(min(free, key=lambda p: (abs(p - w), p)) if free else None)
            if free:
                free.remove(want[-1])
        assert assignment.nearest_free(wanted, places) == want


def test_an_early_prefix_takes_what_a_later_row_wanted(spark):
    long = "the same thirty characters and a bit"
    left = [(1, 0, long + " more that is cut"), (1, 1, long + " one"), (1, 2, long + " one"), (1, 3, "short"), (1, 4, "short"), (1, 5, None), (1, 6, " ")]
    right = [(1, 0, long + " one"), (1, 1, long + " two"), (1, 9, "short"), (1, 10, "")]
    assert found(spark, left, right) == by_the_rule(left, right) == [(1, 0, 0, "prefix"), (1, 1, 1, "prefix"), (1, 3, 9, "exact")]


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_rule(spark, seed):
    r = random.Random(seed)
    stems = ["Whereas the parties have agreed upon", "Whereas the parties", "whereas no", "Article", "the lender shall at all times keep the books"]
    text = lambda: r.choice(stems) + r.choice(["", " ", "  on", " on", " a", " the terms", " the  terms", " b c"])
    rows = lambda n: [(d, i, text()) for d in range(6) for i in sorted(r.sample(range(60), n))]
    left, right = rows(25), rows(22)
    assert found(spark, left, right) == by_the_rule(left, right) != []


def test_many_copies_settle_in_few_rounds(spark, monkeypatch):
    rounds, write = [], assignment.written
    monkeypatch.setattr(assignment, "written", lambda df, name: (rounds.append(name), write(df, name))[1])
    left = [(1, i, "one line that is longer than thirty characters" + " and on" * (i % 2)) for i in range(200)]
    right = [(1, i, "one line that is longer than thirty characters" + f" {i % 40}" * (i % 3)) for i in range(200)]
    assert found(spark, left, right) == by_the_rule(left, right)
    assert rounds.count("proposals") <= 6


def test_documents_without_contest_enter_no_round(spark, monkeypatch):
    entered, rounds = [], assignment._in_rounds
    monkeypatch.setattr(assignment, "_in_rounds", lambda a, b, least: (entered.extend(r["doc_id"] for r in a.select("doc_id").distinct().collect()), rounds(a, b, least))[1])
    lines = lambda d: [(d, i, f"a line of document {d} that is number {i % 7} of seven") for i in range(20)] + [(d, 20, "short"), (d, 21, " ")]
    left, right = lines(1) + lines(2) + [(3, 0, "lost")], [(d, 30 - i, t) for d, i, t in lines(1)] + lines(3)
    assert found(spark, left, right) == by_the_rule(left, right) != []
    assert entered == [2]  # its lines have lists and no equal texts
    entered.clear()
    assert found(spark, lines(1), lines(1)) == by_the_rule(lines(1), lines(1))
    assert entered == []


def test_empty_and_clashing(spark):
    assert found(spark, [], [(1, 0, "a")]) == found(spark, [(1, 0, "a")], []) == []
    left = spark.createDataFrame([(1, 0, "abc", 3, "x")], "doc_id int, idx int, text string, place int, begin string")
    assert [tuple(r) for r in assignment.find_matches(left, left).collect()] == [(1, 0, 0, "exact")]


@pytest.mark.skipif(not __import__("os").path.exists("/root/testdata/sf0.001"), reason="no driver tables")
def test_query_over_whole_tables(spark):
    from paragrid.plans import queries

    sf = "/root/testdata/sf0.001"
    lines = [(r["doc_id"], r["idx"], r["text"]) for r in queries.paragraph_rows(spark, sf).collect()]
    left = [(d, i, t[:40] + " (cut)" if i % 3 == 0 and t is not None else t) for d, i, t in lines]
    assert sorted(map(tuple, queries.queue_match(spark, sf).collect())) == by_the_rule(left, [(d, i + 1, t) for d, i, t in lines])
