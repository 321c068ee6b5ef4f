"""Every corpus operator against brute force, on odd texts, null and repeated ids, clashing columns, empty tables."""

import hashlib
import io
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablewright.llm import bpe, decontaminate, html, licenses, quality, rangecoder, registry, simhash, tokenfiles, toxicity, warc

PATH = registry.tokenizer()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return library.encode(text or "", add_special_tokens=False).ids


def key(x):
    return tuple((v is None, str(v)) for v in x)


def test_bpe_equals_the_library(spark, docs, rows, empty, library):
    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, PATH).collect()), key=key)
    want = []
    for i, t in rows:
        ids = ids_of(library, t)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=key)
    assert bpe.round_trip(empty, PATH, with_ids=True).count() == 0


@pytest.mark.parametrize("engine", ["ranks", "library"])
def test_chunks_are_shared_and_joins_repaired(library, engine):
    r = random.Random(3)
    coder = bpe.Coder(PATH, engine, piece_bytes=20000, chunk_bytes=60000)
    shared = " ".join(r.choice(["stone", "river", "don't", "12", "é,", "\n", "x"]) for _ in range(1500))
    texts = [f"{'a' * (k % 7)} start {k} {shared} end{k}" for k in range(12)]
    alphabet = list(" \n\t ab'rsé中\x1c\x85　​.,1") + ["<|endoftext|>", "'re", "  ", " the"]
    texts += ["".join(r.choice(alphabet) for _ in range(n)) for n in (0, 1, 7, 300, 2500) for _ in range(6)]
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [ids_of(library, t) for t in texts]
    assert coder.whole(texts) == coder.by_library(texts)
    assert coder.reused_chunks > coder.encoded_chunks / 4
    for _ in range(50):  # any ids, also those that are no text
        ids = [r.randrange(50257) for _ in range(15)]
        assert coder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_joins_that_do_not_agree_are_widened(library, monkeypatch):
    """Joins made to disagree until they reach over three chunks still give the library's ids."""
    r = random.Random(5)
    texts = [" ".join(r.choice(["stone", "river", "don't", "12", "é,", "x"]) for _ in range(n)) for n in (5, 900, 4000)]
    coder, repair, asked = bpe.Coder(PATH), bpe.Coder._repair, []

    def fussy(self, joins):
        asked.append(len(joins))
        return {x: ids if len(asked) > 4 else None for x, ids in repair(self, joins).items()}

    monkeypatch.setattr(bpe.Coder, "_repair", fussy)
    assert [np.frombuffer(x, "<u4").tolist() for x in coder.encode(texts)] == [ids_of(library, t) for t in texts]
    assert len(asked) > 4
    coder.forget()
    assert not coder.pieces and not coder.chunks and not coder.joins and not any(coder.held.values())


def test_simhash_equals_brute_force(docs, rows, empty):
    want = simhash.brute_force([(10**6 if i is None else i, t) for i, t in rows])
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == Counter((rows[k][0], fp, c) for k, (fp, c) in want.items())
    assert simhash.near_duplicates(empty).count() == 0


def test_links_and_components_over_planted_chains(spark):
    r = random.Random(5)
    values = []
    for _ in range(40):  # chains: each member two bits from the one before
        v = r.getrandbits(64)
        for _ in range(r.randrange(1, 12)):
            values.append(v)
            v ^= (1 << r.randrange(64)) | (1 << r.randrange(64))
    values = list(dict.fromkeys(values))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    roots = dict(tuple(x) for x in simhash.components(simhash.links(spark.createDataFrame([(v,) for v in signed], "fp bigint"))).collect())
    groups = {}
    for v in signed:
        groups.setdefault(roots.get(v, v), set()).add(v)
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 2:
                parent[find(i)] = find(j)
    want = {}
    for i in range(len(values)):
        want.setdefault(find(i), set()).add(signed[i])
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(1)
    tree, values = simhash.BKTree(), [r.getrandbits(16) for _ in range(400)]
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[n] for n in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_quality_counts_equal_brute_force(docs, rows, empty):
    def brute(t):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        runs = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        hit = {j for i in range(len(w) - 4) if runs[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)

    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.apply(docs, []).collect()), key=key)
    want = [(i, *(b := brute(t)), b[0] < 10 or 100 * b[4] > 20 * b[0]) for i, t in rows]
    assert got == sorted(want, key=key)
    assert quality.apply(empty, []).count() == 0


def test_quality_rules_learn_the_planted_condition(spark):
    r = random.Random(2)
    docs, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) + ("###" if bad else "") for _ in range(60)]
        docs.append((i, " ".join(w)))
        labels.append((i, 0 if bad else 1, 0))
    d, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*labels, (None, 0, 0), (3, None, None), (0, 0, 0)], "doc_id bigint, quality int, toxic int")
    rules = quality.fit(d, lab)
    assert rules and quality.apply(d, rules).where("kept != (doc_id % 5 != 0)").count() == 0
    plan = quality.apply(d, rules).select("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan or "NOT" in plan
    assert quality.fit(d, lab.limit(0)) == [] and quality.fit(d.limit(0), lab) == []


def toxic_table(spark, size=1500):
    r = random.Random(4)
    bad = ["idiot", "moron", "scum", "1d1ot"]
    docs, labels = [], []
    for i in range(size):
        w = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 6))) for _ in range(r.randrange(5, 60))]
        if toxic := i % 6 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(bad))
        docs.append((i, " ".join(w), "en"))
        labels.append((i, 1, int(toxic)))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity_held_out_accuracy(spark):
    docs, labels = toxic_table(spark)
    model = toxicity.fit(docs, labels)
    rows = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert sum(r.predicted == int(r.doc_id % 6 == 0) for r in rows) >= 0.97 * len(rows)
    # held-out labels change nothing
    from tablewright.llm.common import held_out

    other = labels.withColumn("toxic", F.when(held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    again = {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, other)).collect()}
    assert all(again[r.doc_id] == r.score for r in rows)


def test_toxicity_edges(spark, docs, rows, empty):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 0), (2, None, None)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)  # too few labels: their share
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.fit(empty, labels).prior == 0


@pytest.mark.parametrize("size", [300, 1500, 5000])
def test_toxicity_is_fitted_alike_at_every_size(spark, size):
    docs, labels = toxic_table(spark, size)
    model = toxicity.fit(docs, labels)
    assert model.trees.trees and len(model.knots[0]) >= 2 and model.strong
    held = [r for r in toxicity.score(docs, model).collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    hit = sum(r.predicted and r.doc_id % 6 == 0 for r in held)
    assert hit >= 0.9 * sum(r.doc_id % 6 == 0 for r in held) and hit >= 0.9 * sum(r.predicted for r in held)
    # the order of rows, and rows that repeat, decide nothing
    again = toxicity.fit(docs.union(docs).orderBy(F.desc("doc_id")).repartition(3), labels.union(labels).orderBy(F.rand(1)))
    assert (again.strong, again.weak, again.knots, again.trees) == (model.strong, model.weak, model.knots, model.trees)


def test_toxic_words_anywhere_in_a_long_text_teach(spark):
    filler = " ".join(["plain"] * 30_000)
    docs = [(i, f"{filler} {'vile rude' if i % 2 else 'kind good'} {filler}") for i in range(80)]
    docs, labels = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert "vile" in model.strong | model.weak
    assert all(r.predicted == r.doc_id % 2 for r in toxicity.score(docs, model).collect())


def features_twin(text, strong, weak):
    """A direct reading of the features' definitions, word by word."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(toxicity.FEATURES)
    low, hidden = zip(*map(toxicity.folded, words), strict=True)
    grade = [max([0, *(2 for t in strong if w == t or (t[-1] == "*" and w.startswith(t[:-1]) and len(t) > toxicity.SHORTEST)), *(1 for t in weak if w == t or (t[-1] == "*" and w.startswith(t[:-1]) and len(t) > toxicity.SHORTEST))]) for w in low]
    second = [w in toxicity.SECOND_PERSON for w in low]
    n, at = len(words), [i for i, g in enumerate(grade) if g == 2]
    near = sum(any(second[j] for j in range(max(0, i - toxicity.NEAR), min(n, i + toxicity.NEAR + 1)) if j != i) for i in at)
    most = max((sum(i <= j < i + 50 for j in at) for i in at), default=0)
    marks = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    letters = max(1, len(text) - text.count(" ") - marks)
    bangs = text.count("!") + text.count("?")
    weak_n = grade.count(1)
    return [len(at) / n, weak_n / n, np.log1p(len(at)), np.log1p(weak_n), most / min(n, 50), near / n, sum(second) / n, sum("A" <= c <= "Z" for c in text) / letters, sum(w.isupper() and len(x) > 1 for w, x in zip(words, low, strict=True)) / n, marks / len(text), bangs / len(text), sum(hidden) / n, sum(h and g > 0 for h, g in zip(hidden, grade, strict=True)) / n, np.log1p(n)]


def test_toxicity_features_equal_a_twin(texts):
    strong, weak = frozenset(["idiot", "thet*"]), frozenset(["iota", "gamm*"])
    for t in [*texts, "You IDIOT!! id1ot 1diot, y0u are an idiot; iota you", "idiot " * 120]:
        got = toxicity.features_of(t, toxicity._Words(strong, weak))
        assert np.allclose(got, features_twin(t, strong, weak)), t


def test_isotonic_equals_a_twin():
    """Each value of the least-squares non-decreasing fit is the greatest, over starts at or before it, of the
    least mean, over ends at or after it."""
    r = np.random.RandomState(8)
    for n in (1, 2, 7, 60):
        m, y = r.randint(0, 25, n).astype(float), r.randint(0, 2, n).astype(float)
        xs, ys = toxicity.isotonic(m, y)
        values = sorted(set(m))
        mean = lambda a, b: y[(m >= a) & (m <= b)].mean()  # noqa: B023, E731
        for v in values:
            want = max(min(mean(a, b) for b in values if b >= v) for a in values if a <= v)
            assert abs(np.interp(v, xs, ys) - want) < 1e-9


def test_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    m = rng.normal(size=300).round(1)
    xs, ys = toxicity.isotonic(m, (rng.random(300) < 1 / (1 + np.exp(-m))).astype(float))
    assert xs == sorted(xs) and ys == sorted(ys)


def test_decontamination_equals_brute_force(spark, docs, rows, empty):
    texts = [t for _, t in rows]
    items = [(1, texts[7][40:200]), (10, texts[5]), (2, "one"), (3, None), (4, ""), (None, texts[8]), (5, " ".join((texts[-4] or "").split()[500:530])), (5, "two words"), (6, "never seen words in any document at all whatsoever here now")]
    bench = spark.createDataFrame([(i, t, "a", 1) for i, t in items], "item_id bigint, text string, doc_id string, spans int")
    want = sorted(decontaminate.brute_force(rows, items), key=key)
    for size in (48 << 20, 2000):  # in one block, in several
        got = decontaminate.contamination(docs, bench, block_bytes=size).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got), key=key) == want
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())
    assert decontaminate.contamination(empty, bench).count() == 0


def test_warc_round_trip(spark):
    long = "é" * 600
    pages = [(5, "http://a", long), (9, "http://b", long), (7, None, long), (7, "http://c", "short"), (8, "u", "short"), (None, "n", long), (9, "http://b", long), (3, "", None), (4, "x", "")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id bigint, url string, html string, payload int")
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()), key=key)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = len(b) >= 1000 and i is not None and i < 9
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", 9 if again else None))
    assert got == sorted(want, key=key)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_reader_refuses_damage():
    data = b"".join(warc.record("response", f"urn:page:{i}", "http://x", b"payload %d" % i * 50) for i in range(4))
    assert [r.payload for r in warc.records(io.BytesIO(data))] == [b"payload %d" % i * 50 for i in range(4)]
    raw = next(warc.members(io.BytesIO(data)))[1]
    forged = zlib.compressobj(6, zlib.DEFLATED, 31)
    forged = forged.compress(raw.replace(b"payload", b"PAYLOAD")) + forged.flush()
    for bad in (data[:-5], data[:60] + b"\0\0" + data[62:], forged, data + b"junk"):
        with pytest.raises(warc.BrokenArchive):
            list(warc.records(io.BytesIO(bad)))


def test_range_coder_round_trips_and_checks():
    rng = np.random.default_rng(1)
    for a in ([], [5], [0] * 9000, rng.integers(0, 50257, 9001), np.tile(rng.integers(0, 50000, 50), 200), rng.integers(0, 3, 5000)):
        a = np.array(a, np.uint32)
        data = rangecoder.encode(a)
        assert (rangecoder.decode(data) == a).all()
    assert len(rangecoder.encode(np.tile(rng.integers(0, 50000, 50), 200))) < 2000  # repeats are predicted
    for at in (10, len(data) // 2, len(data) - 3):
        with pytest.raises(Exception):  # noqa: B017  (a checksum, or zlib's own)
            rangecoder.decode(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])


def test_words_go_to_the_library_once(library, monkeypatch):
    coder, asked = bpe.Coder(PATH, "library"), []
    plain = bpe.Coder.in_runs
    monkeypatch.setattr(coder, "in_runs", lambda pieces: asked.extend(pieces) or plain(coder, pieces))
    texts = ["a word, word. word!\nword", None, "", " word", "a\n\nword \n", "a\u3000 word\x1c ?!", "it's. 's, <|endoftext|> x", "é. 1.5, x" + "y" * 90 + "."]
    for part in (texts[:1], texts[:1], texts, texts[::-1]):
        if len(part) > 1:  # texts with white space after white space go by pieces
            monkeypatch.undo()
        ids, n = coder.in_one(pa.array(part, pa.string()), end_id=2)
        assert ids.tolist() == [i for t in part for i in (*ids_of(library, t), 2)]
        assert n.tolist() == [len(ids_of(library, t)) + 1 for t in part]
        coder.forget()  # as at the end of a task
    assert asked.count(" word") == 1 and not {" word,", " word.", " word!"} & {*asked}
    assert [len(x) for x in coder.in_one(pa.array([], pa.string()), end_id=2)] == [0, 0]


def seconds(work):
    """CPU seconds of the better of two calls, and what the last gave."""
    took = []
    for _ in range(2):
        start = time.process_time()
        got = work()
        took.append(time.process_time() - start)
    return min(took), got


def test_range_coder_keeps_up_with_the_library(library):
    rng = np.random.default_rng(2)
    words = ["".join(w) for w in rng.choice(list("etaoinshrdlu"), (150_000, 8))]
    texts = [" ".join(words[i : i + 500]) for i in range(0, len(words), 500)]
    encoded, got = seconds(lambda: library.encode_batch_fast(texts, add_special_tokens=False))
    ids = np.array([i for e in got for i in e.ids], np.uint32)
    coded, got = seconds(lambda: rangecoder.decode(rangecoder.encode(np.tile(ids, 2))))
    assert (got[: len(ids)] == ids).all() and coded / 2 < 1.5 * encoded


def test_token_files(spark, docs, rows, empty, library):
    manifest = tokenfiles.write_coded(docs, PATH, file_ids=5000)
    assert manifest.count() >= 2
    got = tokenfiles.read_coded(spark, manifest, with_ids=True).orderBy("start").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        data = np.array([*ids_of(library, t), 2], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, start, len(data) // 4, zlib.crc32(data)) and bytes(r.ids) == data
        start += len(data) // 4
    assert tokenfiles.read_coded(spark, tokenfiles.write_coded(empty, PATH)).count() == 0


def test_token_counts_across_blocks(spark, docs, rows, empty, library):
    sep = len(bpe.Coder.of(PATH).bytes_of)
    manifest = tokenfiles.write_flat(docs, PATH, sep)
    want = sorted(((i, len(ids_of(library, t))) for i, t in rows), key=key)
    for size in (8 << 20, 64, 2):  # documents span blocks, blocks hold no separator
        if size == 2:
            manifest, want = tokenfiles.write_flat(docs.limit(3), PATH, sep), None
        got = sorted(((r.doc_id, r.n_tokens) for r in tokenfiles.counts(manifest, sep, size).collect()), key=key)
        assert want is None and len(got) == 3 or got == want
    assert tokenfiles.counts(tokenfiles.write_flat(empty, PATH, sep), sep).count() == 0


PAGES = [
    ('<html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- x --><div class="ad">Buy this now please.</div><article><h1>Head &amp; line</h1><p><b>Head.<br><p>Body &eacute; one  two\n three</p><p>x</p></article><footer>&copy; me</footer></body></html>', "Head & line\nHead.\nBody é one two three\nx"),
    ("<body><header><p>Site name</p></header><main><h1>Title</h1><p>First part of text.</p><aside>See also</aside><form><p>Mail me</p></form><p>Second <a href=x>linked</a> part.</p></main><section class='comments'><p>Nice article indeed!</p></section><div id='cookie-notice'>We use cookies</div></body>", "Title\nFirst part of text.\nSecond linked part."),
    (None, ""), ("", ""), ("<p", ""), ("<script>only</script>", ""),
    ("<article><p>cut off &am", "cut off &am"),
]


def test_html(spark):
    tree = html.trained()
    for page, text in PAGES:
        assert html.main_text(page, tree) == text
    df = spark.createDataFrame([(i, None if i == 2 else "u", p, 1) for i, (p, _) in enumerate(PAGES)] + [(None, None, PAGES[0][0], 1)], "page_id bigint, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {**{i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}, None: (PAGES[0][1], len(PAGES[0][1]))}
    assert html.extract(df.limit(0)).count() == 0


def test_html_labelled_table_is_learnt():
    tree = html.trained()
    for seed in (11, 99):  # its own pages and others by the same rule
        wrong, blocks_seen = [0, 0], [0, 0]
        for k, page in enumerate(html.labelled_pages(seed=seed)):
            blocks = html.blocks_of(page)
            wrong[k % 2] += sum(x != b.keep for x, b in zip(tree.keeps(html.describe(blocks)), blocks, strict=True))
            blocks_seen[k % 2] += len(blocks)
        assert wrong[0] == 0 and wrong[1] < 0.02 * blocks_seen[1]
    used = {html.FEATURES[n[0]] for n in tree.nodes if n[0] >= 0}
    assert {"words", "link_density", "words_after", "link_density_before"} <= used


def test_html_without_names():
    """Where no tag, class or id says what is main text, words and links of a block and its neighbours do."""
    tree = html.trained()
    nav = "<nav>" + "".join(f"<li><a href=/{i}>item {i}</a></li>" for i in range(6)) + "</nav>"
    prose = "".join(f"<p>{'some words of prose ' * n}</p>" for n in (9, 2, 1, 14))
    page = f"<html><body>{nav}<div class=ad>buy this now here.</div><article><h1>The head line</h1>{prose}</article><footer>&copy; a site of ours</footer></body></html>"
    assert html.main_text(html.unnamed(page), tree) == html.main_text(page, tree) == "\n".join(["The head line", *(" ".join(["some words of prose"] * n) for n in (9, 2, 1, 14))])


def test_html_reads_in_linear_time():
    tree = html.trained()
    bad = ["<p>a</p><a " + "\"'" * 10_000 + "<b>", "<a " * 50_000, '<a b="' * 30_000, "<a b='>" * 30_000, "<b> </b>" * 20_000, "<div>x" * 20_000, "<div>" * 3000 + "</span>" * 20_000, "<script>" * 20_000, "<" * 100_000, "<!--" * 50_000, "&#" * 50_000]
    for page in bad:
        began = time.process_time()
        html.main_text(page, tree)
        assert time.process_time() - began < 2
    began = time.process_time()
    assert html.main_text(bad[0], tree) == "a"
    assert time.process_time() - began < 1
    loop = '<script>for(i=0;i<n;i++){s+="a"}</script><div class="main"><p>Text that stays</p></div>'
    assert html.main_text(loop, tree) == "Text that stays"
    assert html.main_text('<article><p title="a > b">one < two</p><p>x<!-- > --> y</p></article>', tree) == "one < two\nx y"


def test_whole_licence_texts(spark):
    """Planted copies: as they are, in capitals under another holder's lines, wrapped anew; a cut one matches nothing."""
    texts = {k: t for k, t in licenses.KNOWN if len(t) > 5000}
    assert {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0"} <= set(texts)
    rows = []
    for k, t in sorted(texts.items()):
        rows += [(k, t), (k, "Copyright (c) Jane Doe\n\n" + t.upper() + "\n\n"), (k, "© Someone\n" + re.sub(r"[ \t]+", "  ", t)), (None, t[: len(t) // 2])]
    got = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == dict(enumerate(k for k, _ in rows))


def test_licenses(spark, docs, rows, empty):
    mit = next(t for k, t in licenses.KNOWN if k == "MIT")
    zlib_text = next(t for k, t in licenses.KNOWN if k == "Zlib")
    changed = "Copyright (c) 2021 Someone\n" + mit.upper().replace('"SOFTWARE"', "“SOFTWARE”").replace("COPYRIGHT HOLDERS", "Copyright Owners") + "\n"
    df = spark.createDataFrame([(1, mit), (2, changed), (3, mit + " and more"), (4, None), (5, ""), (None, mit), (1, zlib_text)], "doc_id bigint, text string")
    got = sorted(((r.doc_id, r.license_id) for r in licenses.scan(df).collect()), key=key)
    assert got == sorted([(1, "MIT"), (2, "MIT"), (3, None), (4, None), (5, None), (None, "MIT"), (1, "Zlib")], key=key)
    assert licenses.scan(docs).count() == len(rows) and licenses.scan(empty).count() == 0


def test_licenses_equal_duckdb(docs, rows):
    import duckdb
    import pandas as pd

    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    want = con.sql(licenses.oracle()).fetchall()
    got = [tuple(r) for r in licenses.scan(docs).select("doc_id", "n_canonical", "digest", "license_id").collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


MIXED_NAMES = ['class="content has-sidebar"', 'id="content" class="no-comments"', 'class="post-body share-enabled"', 'class="legal-article"', 'class="entry more-info"', 'class="side-effects"', 'class="content related"', 'class="article"', 'class="postContent wide-ads-off"']


@pytest.mark.parametrize("names", MIXED_NAMES)
def test_html_names_of_the_side_within_other_names_lose_no_article(names):
    tree = html.trained()
    prose = [" ".join(f"word{(k * 7 + i) % 90}" for i in range(60)) + "." for k in range(4)]
    body = "<h1>The head line</h1>" + "".join(f"<p>{p}</p>" for p in prose)
    for tag in ("div", "section"):
        page = f"<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><{tag} {names}>{body}</{tag}><div class=footer-links><a href=/x>About us</a></div></body></html>"
        assert html.main_text(page, tree) == "\n".join(["The head line", *prose])


def test_html_compound_names():
    want = {"comment-list": -1, "commentBody": -1, "sidebar-content": -1, "post-footer": -1, "related-posts": -1, "cookie-notice": -1, "breadcrumb-trail": -1, "main-nav": -1, "share-buttons": -1, "ad": -1, "article": 1, "post-content": 1, "legal-article": 1, "article-body": 1, "has-sidebar": 0, "side-effects": 0, "more-info": 0, "no-comments": 0, "node": 0, "": 0}
    assert {k: html.named(k) for k in want} == want
