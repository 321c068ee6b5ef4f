"""The near-dedup stage against Jaccard similarity counted directly on all pairs."""

import random
from itertools import combinations

import numpy as np

import corpus_pipeline
from tablewright.llm import simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """The group of each text, named by its first."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))]


def edited():
    """Texts with copies of which 0 to 12 words are changed, chains of edits, short ones and none."""
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    out = ["", None, " ", "one", "ONE", "two words"]
    for k in range(120):
        w = [word() for _ in range(r.randrange(20, 300))]
        out.append(" ".join(w))
        for _ in range(3):
            w = w[:] if k % 2 else out[-1].split()
            for _ in range(r.randrange(0, 13 if k % 3 else 4)):
                w[r.randrange(len(w))] = word()
            out.append(" ".join(w))
    return out


def test_edited_copies_go(spark):
    texts = edited()
    want = groups(texts)
    assert 130 < len(set(want)) < len(texts) - 130
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA).repartition(5)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(set(want))


def test_second_pass_finds_what_leaders_miss():
    # 2 lies in the middle and leads 1 and 3
    assert simhash.leaders([(1, 0b0000), (2, 0b0001), (3, 0b0011)], 2) == [(1, 2), (2, 3)]
    r = np.random.RandomState(2)
    base = r.randint(0, 1 << 60, 100).astype(np.uint64)
    members = []
    for i in range(60):
        s = base.copy()
        at = r.permutation(100)[: r.randint(0, 25)]
        s[at] = r.randint(0, 1 << 60, len(at))
        members.append((i, simhash.fingerprint_of(s), i // 3, np.unique(s)))
    for radius in (12, 24):
        want = {(a[0], b[0]) for a, b in combinations(members, 2) if (a[1] ^ b[1]).bit_count() <= radius and simhash.jaccard(a[3], b[3]) >= 0.8}
        got = simhash.linked(members, radius, 0.8)
        assert set(got) <= want and len(got) < 60
        same = [(3 * k, 3 * k + j) for k in range(20) for j in (1, 2)]
        assert parts(60, [*got, *same]) == parts(60, [*want, *same])
    empty = np.zeros(0, np.uint64)
    assert simhash.linked([(1, 0, 1, empty), (2, 0, 2, empty)], 2, 0.8) == [(1, 2)]


def parts(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_large_shards_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 7)
    texts = edited()[:200]
    want = groups(texts)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == sorted(set(want))


def test_rows_stay_or_go_one_by_one(spark):
    r = random.Random(5)
    a, b, c, d, e = (" ".join("".join(r.choice("klmnop") for _ in range(6)) for _ in range(40)) for _ in range(5))
    rows = [(None, a), (None, b), (None, b), (1, c), (1, c), (2, d), (1, d), (3, e), (None, e), (None, e)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(3)
    left = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_copies(spark, docs, "").collect()]
    assert sorted(left, key=str) == sorted([(None, a), (None, b), (1, c), (1, d), (3, e)], key=str)


def test_only_contaminated_rows_go(spark, tmp_path):
    r = random.Random(6)
    passage, other = (" ".join("".join(r.choice("qrstuv") for _ in range(6)) for _ in range(20)) for _ in range(2))
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, passage), (1, other), (None, f"x {passage} y"), (None, other), (2, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    left = [(x.doc_id, x.text) for x in corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path)).collect()]
    assert sorted(left, key=str) == sorted([(1, other), (None, other), (2, None)], key=str)
