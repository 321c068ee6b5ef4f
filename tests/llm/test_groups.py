"""Exact copies, spelling variants and collocations against brute force: odd texts, nulls, repeats, clashing columns, hot keys, empty tables."""

import hashlib
import random
import re

import pytest

from tablewright.llm import decontaminate, exact, phrases, spelling


def key(x):
    return tuple((v is None, str(v)) for v in x)


def copies_of(rows):
    groups = {}
    for n, (i, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((i is None, i or 0, n))
    out = []
    for t, members in groups.items():
        first = min(members)
        out += [(rows[n][0], None if first[0] else first[1], len(members), (none, i, n) == first, hashlib.sha256(t.encode()).hexdigest()) for none, i, n in members]
    return sorted(out, key=key)


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_copies_equal_brute_force(spark, docs, rows, empty, bits):
    """At three bits nearly all chunks share a hash and are told apart by their texts."""
    got = sorted(map(tuple, exact.exact_copies(docs, bits=bits).collect()), key=key)
    assert got == copies_of(rows)
    assert exact.exact_copies(empty, bits=bits).count() == 0


def test_a_large_group_of_copies_is_joined_in_portions(spark, monkeypatch):
    monkeypatch.setattr(exact, "PORTION", 7)
    rows = [(i if i % 5 else None, "the same  text" if i % 3 else f"text {i % 11}\n") for i in range(400)]
    df = spark.createDataFrame([(i, t.replace("  ", "\t" if k % 2 else " "), 1) for k, (i, t) in enumerate(rows)], "doc_id bigint, text string, _list int")
    assert sorted(map(tuple, exact.exact_copies(df).collect()), key=key) == copies_of(rows)


def test_chunks_join_to_the_text_and_are_cut_by_content(spark):
    r = random.Random(4)
    words = ["stone", "river,", "été", "数。", "x" * 200, "a", "b.c", "..."]
    body = " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(30000))
    texts = [body, "one more at the front " + body, "", " ", " a ", "a b " * 20000, "x" * 100000, None, "." * 5000, "a,b " * 9000]
    got = [x[0] for x in exact.chunked(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string"), ["i"], "text").orderBy("i").select("_chunks").collect()]
    assert ["".join(c) for c in got] == [re.sub(r"\s+", " ", t or "") for t in texts]
    assert all(len(re.findall(exact.PIECE, c)) <= exact.FAR for x in got for c in x)
    assert len(set(got[0]) & set(got[1])) > 0.95 * len(set(got[0])) > 100
    assert got[2] == got[7] == []


@pytest.mark.parametrize("bits", [phrases.BITS, 64])
def test_collocations_equal_brute_force(spark, docs, rows, empty, bits, monkeypatch):
    """A bitmap of 64 bits lets nearly everything pass, and changes nothing."""
    monkeypatch.setattr(phrases, "BITS", bits)
    for options in ({"least": 2}, {"least": 2, "max_n": 2}, {"least": 3, "max_n": 4, "explained": 80, "top": 20}):
        assert sorted(map(tuple, phrases.collocations(docs, **options).collect())) == sorted(phrases.brute_force([("en", t) for _, t in rows], **options))
    assert phrases.collocations(empty).count() == 0


def test_collocations_of_hot_words_many_languages_and_pieces(spark):
    r = random.Random(9)
    rows = []
    for k in range(300):
        words = [r.choice(["the", "the", "The", "of", "New", "York", "times", "É", f"w{r.randrange(40)}"]) for _ in range(r.randrange(0, 60))]
        rows.append((r.choice(["en", "en", "fr", None, ""]), "".join(w + r.choice([" ", " ", "\t", "  ", ", ", ".\n", " "]) for w in words)))
    rows += [("en", None), ("xx", ""), (None, "..")]
    df = spark.createDataFrame([(t, lang, 1, "p") for lang, t in rows], "text string, lang string, _f int, phrase string")
    for options in ({}, {"least": 4, "top": 15}):
        got = sorted(map(tuple, phrases.collocations(df, **options).collect()))
        assert got == sorted(phrases.brute_force(rows, **options)) and got
    with pytest.raises(ValueError):
        phrases.collocations(df, max_n=1)


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts of 10 to the 11th: products of four such numbers still divide exactly."""
    a, l, r = 99_999_999_977, 100_000_000_003, 123_456_789_012
    monkeypatch.setattr(phrases, "counts", lambda *_: spark.createDataFrame([("en", "x", l, 1), ("en", "y", r, 1), ("en", "x y", a, 2)], "_lang string, _phrase string, _f bigint, _k int"))
    assert [tuple(x) for x in phrases.collocations(None).collect()] == [("en", 1, "x y", a, l, r, l + r, 1000000 * a * a // (l * r))]


def variants(seed=3, n=400):
    r = random.Random(seed)
    base = ["".join(r.choice("abcdeé") for _ in range(r.randrange(6, 12))) for _ in range(60)]
    base += ["shared" + "".join(r.choice("ab") for _ in range(6)) for _ in range(60)]
    rows = []
    for k in range(n):
        words = []
        for _ in range(r.randrange(0, 40)):
            w = base[min(int(r.expovariate(0.06)), len(base) - 1)]
            i = r.randrange(len(w))
            words.append(r.choice([w, w, w, w[:i] + w[i + 1 :], w[:i] + r.choice("abÀ") + w[i + 1 :], w[:i] + "d" + w[i:], w.upper()]))
        rows.append((k if k % 9 else None, r.choice([" ", "-", "1", "Ā"]).join(words)))
    return [*rows, (1, None), (2, ""), (3, "short"), (4, "word" * 5000), (4, "word" * 5000)]


@pytest.mark.parametrize("shard", [20000, 40])
def test_spelling_equals_brute_force(spark, docs, rows, empty, shard):
    """With 40 words a shard, halves that more words share are dealt to several."""
    planted = variants()
    df = spark.createDataFrame([(i, t, 1, "h") for i, t in planted], "doc_id bigint, text string, n int, half string")
    for options in ({}, {"ratio": 2, "least_length": 3, "least_n": 1}):
        got = sorted(map(tuple, spelling.spelling_groups(df, shard=shard, **options).collect()), key=key)
        assert got == sorted(spelling.brute_force(planted, **options), key=key)
        assert sum(x[1] is not None for x in got) > 20
    assert sorted(map(tuple, spelling.spelling_groups(docs, shard=shard).collect()), key=key) == sorted(spelling.brute_force(rows), key=key)
    assert spelling.spelling_groups(empty).count() == 0


def test_chains_of_forms_lead_to_their_end(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "d"), ("y", "z")], "word string, form string")
    assert dict(map(tuple, spelling.roots(edges).collect())) == {"a": "d", "b": "d", "c": "d", "x": "d", "y": "z"}


def test_one_apart():
    r = random.Random(2)
    for _ in range(3000):
        a, b = ("".join(r.choice("ab") for _ in range(r.randrange(0, 6))) for _ in range(2))
        near = {a[:i] + a[i + 1 :] for i in range(len(a))} | {a[:i] + c + a[i + d :] for i in range(len(a) + 1) for c in "ab" for d in (0, 1)}
        assert spelling.one_apart(a, b) == (a != b and b in near and abs(len(a) - len(b)) <= 1)


def test_native_plan_has_no_python(spark, docs):
    plan = exact.exact_copies(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_blocks_of_windows_are_bounded_by_the_ids_too(spark):
    """Many items of one text: every block stays within its bytes, and together they hold each window of each item once."""
    text = " ".join(f"w{i}" for i in range(12))
    items = spark.range(20000).selectExpr("cast(id as string) as item_id", f"'{text}' as text")
    seen = set()
    for block in decontaminate._blocks(items, "item_id", "text", 10, 20000):
        used = sum(sum(map(len, w)) + decontaminate.WINDOW_BYTES + sum(len(i) + decontaminate.ID_BYTES for i in ids) for w, ids in block.items())
        assert used <= 20000 + 300
        pairs = {(w, i) for w, ids in block.items() for i in ids}
        assert not pairs & seen
        seen |= pairs
    assert len(seen) == 3 * 20000


def test_items_of_one_text_over_several_blocks(spark):
    text = " ".join(f"w{i}" for i in range(12))
    items = [(str(i), text) for i in range(60)] + [("short", "w3 w4"), (None, "x y"), ("empty", "")]
    docs = [(1, f"a {text} b"), (2, "w3 w4 " * 3), (3, None), (4, "nothing")]
    df, bench = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")
    got = decontaminate.contamination(df, bench, block_bytes=2000).collect()
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == sorted(decontaminate.brute_force(docs, items))
