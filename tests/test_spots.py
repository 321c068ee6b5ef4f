"""Queries on the places of tables take every table of a report: against direct readings of all of them."""

import os
from collections import Counter, defaultdict

import pytest

from tablewright.plans.base import view
from tablewright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


@pytest.fixture(scope="module")
def reports(spark):
    out = defaultdict(list)
    for r in view(spark, SF, "placed").collect():
        out[r.code, r.year].append(r)
    assert max(map(len, out.values())) > 12
    return out


def test_following(spark, reports):
    want = Counter()
    for key, tables in reports.items():
        by = defaultdict(list)
        for a in tables:
            for b in tables:
                near = (b.page == a.page and 0 <= b.top - a.bottom <= 180) or (b.page == a.page + 1 and b.top <= 150)
                if near and abs(b.cols - a.cols) <= 2:
                    by[a.table_id, a.page, a.top].append((b.page, b.top, b.table_id))
        want.update((*key, *a, n, i) for a, found in by.items() for i, (_, _, n) in enumerate(sorted(found)[:2], 1))
    assert Counter(map(tuple, QUERIES["q_following"](spark, SF).collect())) == want


def test_neighbors(spark, reports):
    want = Counter()
    for key, tables in reports.items():
        t = sorted((r.page, r.top, r.table_id) for r in tables)
        want.update((*key, a[2], a[0], b[2], b[0]) for a, b in zip(t, [*t[1:], (None, None, None)], strict=True))
    assert Counter(map(tuple, QUERIES["q_neighbors"](spark, SF).collect())) == want


def test_provenance(spark, reports):
    votes, pages = {}, {}
    for key, tables in reports.items():
        cells = [(r.page, r.top + 10, r.top + 20) for r in sorted(tables, key=lambda r: (r.page, r.top, r.table_id)) if r.cols == 2]
        if not cells:
            continue
        n = Counter(p for p, _, _ in cells)
        pages[key] = min(n, key=lambda p: (-n[p], p))
        v, s = Counter(), Counter()  # a row that repeats a table's id and place votes once
        for t in tables:
            for item, (p, y0, y1) in enumerate(cells):
                if p == t.page:
                    over = y0 < t.bottom + 3 and y1 > t.top - 3
                    vote = 3 if over and t.top <= y0 and y1 <= t.bottom - 30 else 2 if over else 1
                    v[t.table_id, t.top, item] = max(vote, v[t.table_id, t.top, item])
        for (table_id, top, _), vote in v.items():
            s[table_id, top] += vote
        best = min(s, key=lambda x: (-s[x], x))
        votes[key] = (best[0], s[best])
    assert {(r.code, r.year): (r.table_id, r.votes) for r in QUERIES["q_prov_vote"](spark, SF).collect()} == votes
    assert {(r.code, r.year): r.page for r in QUERIES["q_prov_page"](spark, SF).collect()} == pages
