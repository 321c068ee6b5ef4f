"""The pipeline's stages, each against a direct reading of what it has to do with its own input."""

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tablewright.llm import decontaminate, quality
from tablewright.llm.registry import tokenizer

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
PASSAGE = "stone river cloud tree moss fern brook hill dale glen cliff shore reef dune marsh"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6))) for _ in range(n))


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    r = random.Random(9)
    rows, labels = [], []
    for i in range(900):
        words = prose(r, r.randrange(20, 60)).split()
        toxic, junk = i % 6 == 0, i % 6 == 3
        for _ in range(3 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["idiot", "moron", "scum"]))
        if junk:
            words = [w + "#$%" if k % 2 else w for k, w in enumerate(words)]
        rows.append((i, " ".join(words)))
        labels.append((i, int(not junk), int(toxic)))
    clean = [x for x in rows if x[0] % 6 in (1, 2)]
    rows += [(5000 + k, t) for k, (_, t) in enumerate(clean[:30])]  # exact copies
    rows += [(5100 + k, t + " and two") for k, (_, t) in enumerate(clean[30:60])]  # near copies
    rows += [(6000 + k, f"{t} {PASSAGE} tail") for k, (_, t) in enumerate(clean[60:65])]
    rows += [(None, prose(r, 40)), (None, prose(r, 40)), (None, clean[0][1]), (None, f"{prose(r, 30)} {PASSAGE}")]
    rows += [clean[1], clean[1]]  # repeated rows
    rows += [(clean[2][0], prose(r, 50)), (6001, prose(r, 50)), (clean[3][0], f"{prose(r, 30)} {PASSAGE}")]  # ids shared with a copy, a contaminated row, a clean row
    rows += [(7000, None), (7001, ""), (7002, "too short")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], SCHEMA).write.parquet(os.path.join(d, "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(os.path.join(d, "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE), (2, None)], "item_id bigint, text string").write.parquet(os.path.join(d, "benchmark.parquet"))
    return d


def copies_left(rows, width=5, least=0.8):
    """Of each group of rows linked by Jaccard similarity the one with the least id, a null one last."""
    sets = [{tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if (w := (t or "").lower().split()) else set() for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (len(a & b) / len(a | b) if a or b else 1.0) >= least:
                root[find(i)] = find(j)
    groups: dict = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append((k is None, k or 0, i))
    return Counter(rows[min(g)[2]] if sum(x[:2] == min(g)[:2] for x in g) == 1 else (min(g)[1], None) for g in groups.values())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rules = quality.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    assert rules and "symbols_per_word" in {t.name for rule in rules for t in rule}
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        docs = stage(spark, docs, sf)
        assert tuple(docs.columns) == corpus_pipeline.COLUMNS
        after = [(r.doc_id, r.text) for r in docs.collect()]
        gone = Counter(before) - Counter(after)
        assert not Counter(after) - Counter(before)
        sizes.append(len(after))
        if name.startswith("toxicity"):
            toxic = Counter(x for x in before if re.search("idiot|moron|scum", x[1] or ""))
            assert gone == toxic and toxic
        if name.startswith("quality"):
            assert gone == Counter(x for x in before if len((x[1] or "").split()) < 10 or "#" in x[1])
        if name.startswith("simhash"):
            want = copies_left(before)
            got = Counter(after)
            # where rows of one id tie, which of their texts stays is the operator's choice
            exact = {x: n for x, n in want.items() if x[1] is not None}
            assert sum(want.values()) == len(after) and all(got[x] == n for x, n in exact.items())
            assert sum(i is None for i, _ in after) == 3  # unique texts with a null id stay
        if name.startswith("benchmark"):
            hit = Counter(x for x in before if PASSAGE in (x[1] or ""))
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            assert gone == hit == Counter(x for x in before if decontaminate.brute_force([x], items)[0][5])
            assert any(i is None for i, _ in hit) and any(i == 6001 for i, _ in after)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 500
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer())
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    got = [tuple(r) for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()]
    assert Counter(got) == Counter(want)
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, sf).collect()) == Counter(want)


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
