"""Substring and near-duplicate removal, top-k search, mixing, personal data and the pipeline against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from trailhead.llm import components, mixing, passages, pii, queries, substrings, suffix_dedup, topk, weighted_minhash
from trailhead.llm.automaton import SuffixAutomaton


def named(df):
    return df.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("sig"), F.col("text").alias("value"))


def removed_units(spans_df, frame):
    sig = {(r.doc, r.value): r.sig for r in named(frame).collect()}
    found = {(r.doc, r.sig): passages.merged([x.asDict() for x in r.spans]) for r in spans_df.collect()}
    return lambda doc, text: found.get((doc, sig[doc, text]), [])


def covered(flags, size):
    out, last = [], -1
    for i, f in enumerate(flags):
        if f:
            if out and i <= out[-1][1]:
                out[-1][1] = i + size
            else:
                out.append([i, i + size])
    return [tuple(x) for x in out]


@pytest.fixture(scope="module")
def snippets():
    random.seed(5)
    base = ["".join(random.choice("abcdé ") for _ in range(120)) for _ in range(6)]
    docs = [(i, "".join(random.choice(base)[random.randint(0, 60):random.randint(61, 120)] for _ in range(random.randint(0, 6)))) for i in range(60)]
    return docs + [(70, None), (None, base[0]), (100, "a" * 500), (101, "ab" * 200), (101, "ab" * 200), (102, "x" * 39)]


@pytest.mark.parametrize("group_bytes", [4 << 20, 300])
def test_byte_dedup(spark, snippets, group_bytes):
    frame = spark.createDataFrame(snippets, "doc_id int, text string")
    got = removed_units(suffix_dedup.repeated(named(frame), 40, "none", group_bytes), frame)
    raw = [(d, t, (t or "").encode()) for d, t in snippets]
    counts = Counter(b[i:i + 40] for _, _, b in raw for i in range(len(b) - 39))
    for d, t, b in raw:
        assert got(d, t) == covered([counts[b[i:i + 40]] > 1 for i in range(len(b) - 39)], 40)


@pytest.mark.parametrize("group_bytes", [4 << 20, 300])
def test_byte_dedup_keeps_the_first(spark, snippets, group_bytes):
    docs = [x for x in snippets if x[0] not in (101, None)]       # equal rows share a place
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = removed_units(suffix_dedup.repeated(named(frame), 40, "first", group_bytes), frame)
    seen = set()
    for d, t in sorted(docs):
        b = (t or "").encode()
        flags = []
        for i in range(len(b) - 39):
            flags.append(b[i:i + 40] in seen)
            seen.add(b[i:i + 40])
        assert got(d, t) == covered(flags, 40)


def test_longest_previous_factors():
    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 300).astype(np.uint8)
    starts = np.arange(260)
    earlier, later = suffix_dedup.factors(raw, starts, 16)
    text = raw.tobytes()

    def common(i, j):
        n = 0
        while max(i, j) + n < 300 and text[i + n] == text[j + n]:
            n += 1
        return n

    for i in starts:
        assert min(earlier[i], 16) == min(max((common(i, j) for j in range(i)), default=0), 16)
        assert min(later[i], 16) == min(max((common(i, j) for j in range(i + 1, 260)), default=0), 16)


@pytest.mark.parametrize("group_words", [100_000, 20])
def test_word_dedup(spark, group_words):
    random.seed(5)
    base = [[random.choice("a b c d e f é g".split()) for _ in range(40)] for _ in range(6)]
    docs = [(i if i != 9 else None, " ".join(w for _ in range(random.randint(0, 6)) for w in random.choice(base)[random.randint(0, 20):random.randint(21, 40)]) if i != 7 else None)
            for i in range(60)] + [(100, "a " * 50), (101, "a b " * 20), (101, "a b " * 20)]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    got = removed_units(substrings.repeated(named(frame), 8, group_words), frame)
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t in docs:
        w = (t or "").split()
        for i in range(len(w) - 7):
            g = tuple(w[i:i + 8])
            first[g] = min(first.get(g, order(d)), order(d))
    for d, t in docs:
        w = (t or "").split()
        assert got(d, t) == covered([first[tuple(w[i:i + 8])] < order(d) for i in range(len(w) - 7)], 8)
    assert substrings.dedup(frame.limit(0)).count() == 0 and suffix_dedup.dedup(frame.limit(0)).count() == 0


@pytest.mark.parametrize("operator, size, window", [(substrings, 8, "words"), (suffix_dedup, 40, "bytes")])
def test_no_task_holds_the_passages_of_a_crowded_anchor(spark, monkeypatch, operator, size, window):
    random.seed(8)
    word = lambda n: " ".join("".join(random.choice("abcdefghij") for _ in range(4)) for _ in range(n))
    shared, limit = word(14), 2_000
    docs = [(i if i != 5 else None, f"{word(12)} {shared} {word(12) if i % 10 else 'same end of some of them here'}") for i in range(300)]
    frame = spark.createDataFrame(docs, "doc_id int, text string")
    inner = passages.in_groups

    def in_groups(batches, least):
        for held in inner(batches, least):
            assert all(sum(len(r["units"]) for r in g) <= (5 if window == "words" else 1) * limit for g in held), "a task holds a whole crowded group"
            yield held

    monkeypatch.setattr(operator, "in_groups", in_groups)
    got = removed_units(operator.repeated(named(frame), size, group_words=limit) if window == "words"
                        else operator.repeated(named(frame), size, "first", group_bytes=limit), frame)
    seen = set()
    for d, t in sorted(docs, key=lambda x: (x[0] is None, x[0])):
        u = t.split() if window == "words" else t.encode()
        grams = [tuple(u[i:i + size]) for i in range(len(u) - size + 1)]
        assert got(d, t) == covered([g in seen for g in grams], size)
        seen.update(grams)


def test_automaton_finds_the_least_holder():
    random.seed(2)
    texts = ["".join(random.choice("ab") for _ in range(30)) for _ in range(8)]
    shard = SuffixAutomaton()
    for value, t in enumerate(texts):
        shard.add(t, value)
    shard.finish()
    probe = "".join(random.choice("abc") for _ in range(60))
    for end, (length, state) in enumerate(shard.statistics(probe), 1):
        assert length == max(n for n in range(end + 1) if any(probe[end - n:end] in t for t in texts))
        for size in range(1, length + 1):
            assert shard.least_of(state, size) == min(v for v, t in enumerate(texts) if probe[end - size:end] in t)


def test_near_duplicate_classes(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r.doc: r.class_id for r in weighted_minhash.classes(docs).collect()}
    weights, shingle = weighted_minhash.Weights(*weighted_minhash.frequencies(docs)), weighted_minhash.Shingler()
    sets = {r.doc_id: shingle(r.text) for r in docs.collect()}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and weighted_minhash.jaccard(weights, sets[a], sets[b]) >= 0.8:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: top(i) for i in sets}


@pytest.mark.parametrize("bits", [6, 20])
def test_near_duplicates_are_verified_by_exact_frequencies(spark, bits):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    template = [word() for _ in range(120)]
    docs = [(i, " ".join(template + [word() for _ in range(n)])) for i, n in enumerate([6, 7, 8, 9, 10, 11, 12, 14, 16, 20] * 3)]
    docs += [(100 + i, " ".join(word() for _ in range(200))) for i in range(120)]
    docs += [(300 + i, t[:-len(t) // 14]) for i, t in docs[30:40]]
    shingles = {i: Counter(zip(*[t.split()[k:] for k in range(5)])) for i, t in docs}
    seen = Counter(g for c in shingles.values() for g in c)
    root = {i: i for i in shingles}
    top = lambda x: x if root[x] == x else top(root[x])
    for a, ca in shingles.items():
        for b, cb in shingles.items():
            if a < b and ca.keys() & cb.keys():
                idf = {g: np.log((1 + len(docs)) / (1 + seen[g])) + 1 for g in ca | cb}
                if sum(min(ca[g], cb[g]) * w for g, w in idf.items()) >= 0.8 * sum(max(ca[g], cb[g]) * w for g, w in idf.items()):
                    x, y = top(a), top(b)
                    root[max(x, y)] = min(x, y)
    got = {r.doc: r.class_id for r in weighted_minhash.classes(spark.createDataFrame(docs, "doc_id int, text string"), bits=bits).collect()}
    assert got == {i: top(i) for i in shingles}
    assert len(set(got.values())) not in (1, len(docs))


def test_sampling_follows_weighted_jaccard():
    rng = np.random.default_rng(0)
    sampler = weighted_minhash.Sampler(2000)
    shingles = rng.integers(0, 1 << 63, 80, dtype=np.uint64)
    wa, wb = rng.uniform(1, 9, 80), rng.uniform(1, 9, 80)
    wb[:20] = 1e-6
    a, b = (sampler(shingles, np.log(w).astype(np.float32), np.array([0]))[0] for w in (wa, wb))
    assert abs((a == b).mean() - np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()) < 0.04


def test_near_duplicates_defined_cases(spark):
    rows = [(1, None, 1), (2, "", 2), (3, "a b", 3), (4, "a b", 4), (None, "a b c d e f", 5), (6, "a b c d e f", 6), (8, "a", 8), (8, "a", 9)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, sig int")
    assert sorted(r.doc_id for r in weighted_minhash.dedup(docs).collect()) == [1, 2, 3, 6, 8]
    assert weighted_minhash.classes(docs).count() == len(rows)
    assert weighted_minhash.classes(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, x) for x in range(101, 140)] + [(5, 5)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{i: 100 for i in range(100, 140)}}


@pytest.mark.parametrize(("scale", "shift"), [(1.0, 0), (1e12, 0), (1.0, -150), (1e12, -290), (1.0, -1000)])
def test_top_k_matches_brute_force(spark, scale, shift):
    rng = np.random.default_rng(3)
    vectors = [(i + shift, [float(x) for x in np.round(rng.normal(size=6) * 4) * scale]) for i in range(300)]
    vectors += [(300, None), (301, [1.0, None]), (302, [float("nan")]), (303, []), (None, [1.0]), (304, [2.0 * scale, 1.0])]
    rows = topk.usable(spark.createDataFrame(vectors, "id int, v array<double>"), "id", "v")
    got = topk.search(rows, rows.where("id % 20 = 0"), k=7, block_rows=16, chunk_blocks=3, slice_rows=5, query_step=2).collect()
    ok = {i: v for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for q in (i for i in ok if i % 20 == 0):
        scored = sorted((max(-(1 << 63), min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(ok[q], v)))) * -1, i) for i, v in ok.items() if i != q)[:7]
        assert [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == [(i, -s) for s, i in scored]
    assert topk.search(rows.limit(0), rows.limit(0)).count() == 0


def test_mix_meets_targets(spark):
    rng = np.random.default_rng(6)
    docs = [(i, f"s{i % 3}" if i % 7 else None, int(rng.integers(0, 400))) for i in range(900)] + [(5, "s2", 100), (None, "s0", 50)]
    frame = spark.createDataFrame(docs, "doc_id int, source string, size long")
    got = mixing.mix(frame, block=40).select("row.source", "row.doc_id", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(docs) and all(0 <= r.copies <= 2 for r in got)
    again = mixing.mix(frame, block=40).select("row.source", "row.doc_id", "size", "source_size", "target", "copies").collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    total, left, weights = sum(d[2] for d in docs) * 1.5, {}, {"s0": 3, "s1": 1, "s2": 2, None: 3}
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    open_ = set(sizes)
    while True:     # share by weight, cap, share again
        room = total - sum(2 * sizes[s] for s in sizes if s not in open_)
        left = {s: room * weights[s] / sum(weights[x] for x in open_) for s in open_}
        over = {s for s in open_ if left[s] > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    for s in sizes:
        target = left[s] if s in open_ else 2 * sizes[s]
        mine = [r for r in got if r.source == s]
        assert abs(mine[0].target - target) < 1e-6 * target
        assert abs(sum(r.copies * r.size for r in mine) - target) <= 0.02 * target
    assert mixing.mix(frame.limit(0)).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def personal(text):
    def valid(kind, m):
        digits = re.sub("[^0-9]", "", m)
        if kind == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if kind == "card":
            doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            return 16 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in doubled) % 10 == 0
        return kind == "email" or 8 <= len(digits) <= 15

    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_personal_data_base_spans(spark, sf):
    random.seed(2)
    bits = ["1", "22", "255", "256", "+1", " ", "-", ".", "@", "a", "é", "🙂", "(", ")", "\n", "4111 1111 1111 1111", "+", "_", "x@y.z", "1.2.3.4", "0", "999", "%"]
    docs = [(i, "".join(random.choice(bits) for _ in range(random.randint(0, 40)))) for i in range(800)] + [(900, None), (901, "1 " * 2000), (901, "1 " * 2000), (None, "x@y.z")]
    docs += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for r in pii.extract(spark.createDataFrame(docs, "doc_id int, text string").repartition(4)).select("row.text", "base", "spans").collect():
        base = [tuple(x) for x in r.base]
        assert base == personal(r.text)
        assert set(base) <= {tuple(x) for x in r.spans}


def test_personal_data_by_context(spark):
    docs = [(i, f"reach me ssn-mail: user{i}@mail.com now") for i in range(30)] + [(100, "reach me ssn-mail: weird99 now"), (101, "some other weird99 text")]
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in pii.extract(spark.createDataFrame(docs, "doc_id int, text string")).select("row.doc_id", "spans").collect()}
    assert got[100] == [("email", 19, 26)] and got[101] == []


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit(1))
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, stage(spark, docs, sf).cache()
        assert docs.columns == columns, name
        if name != "source mix":
            assert docs.count() <= before.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(last) == docs.count() and all(r.round_trip and r.n_tokens == len(r.ids) for r in last)
    empty = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
    assert empty.count() == 0


def test_contexts_are_whole_words_of_the_text(spark):
    long = "w" * 300
    texts = ["call 030 1234567 now", f"{long} a1b2c3 {long}", "x 1111 2222 3333 4444 y", f"one {long} 5555", "6666", f"{'pad ' * 40}left 7777 right {'pad ' * 40}"]
    found = pii._find(spark.createDataFrame(list(enumerate(texts)), "i int, value string"), {"mention": pii.MENTION})
    seen = 0
    for r in found.collect():
        words = texts[r.i].split()
        for s in r.s_mention:
            assert texts[r.i][s.start:s.end] == s.text
            at = len(texts[r.i][:s.start].split())
            assert s.before.split()[-2:] == words[max(at - 2, 0):at] and s.after.split()[:1] == words[at + 1:at + 2]
            seen += 1
    assert seen == 10


def test_pii_finds_numbers_behind_long_words_and_other_mentions(spark):
    """Identifiers that no rule finds stand behind a long word, or behind a mention; the words there decide, however long."""
    random.seed(4)
    label, number = "kontonummer" * 8, lambda n: "".join(random.choice("0123456789") for _ in range(n))
    seeds = [f"{label} +49 {number(9)} ende" for _ in range(60)]
    unseen = [f"{label} {number(7)} ende" for _ in range(20)]
    other = [f"aktenzeichen {number(7)} ablage" for _ in range(20)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(seeds + unseen + other)], "doc_id int, text string, spans string, uid int")
    got = {r.doc_id: [s.kind for s in r["spans"]] for r in pii.extract(docs).select("row.doc_id", "spans").collect()}
    assert all(got[i] == ["phone"] for i in range(60))
    assert sum(got[i] == ["phone"] for i in range(60, 80)) >= 18
    assert all(got[i] == [] for i in range(80, 100))
    assert pii.extract(docs.limit(0)).count() == 0


def test_shingles_are_those_of_the_words(monkeypatch):
    """Equal words have equal hashes wherever they stand, also in texts that are hashed in many steps; counts are those of word windows."""
    random.seed(6)
    monkeypatch.setattr(weighted_minhash, "STEP", 16)
    shingle, known = weighted_minhash.Shingler(5), {}
    for _ in range(400):
        text = "".join(random.choice(["a", "b", "ab", " ", "\n", "é", "  ", "\x1c", "x" * 40]) for _ in range(random.randint(0, 40)))
        words = text.encode().split()
        hashes = shingle.words(text).tolist()
        assert len(hashes) == len(words) and all(known.setdefault(w, h) == h for w, h in zip(words, hashes))
        windows = {}
        for i in range(max(len(words) - 4, min(len(words), 1))):
            windows[tuple(words[i:i + 5])] = windows.get(tuple(words[i:i + 5]), 0) + 1
        found, counts = shingle(text)
        assert sorted(counts.tolist()) == sorted(windows.values()) and (found[1:] > found[:-1]).all()
    assert len(set(known.values())) == len(known) and len(shingle(None)[0]) == 0


def test_long_words_have_hashes_of_their_own():
    """Sums of powers are equal for some long words by design (Thue-Morse); the hashes that op3 compares are not."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(4096))
    b = a.translate(str.maketrans("ab", "ba"))
    hashes = substrings.scheme(13).hashes()
    assert len(set(hashes(f"x {a} y {b} {a} x").tolist())) == 4 and len(hashes(None)) == 0
    assert len(set(weighted_minhash.Shingler().words(f"{a} {b}").tolist())) == 1


def test_rounds_without_links_form_no_components(spark, monkeypatch):
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words, f"x{i}"])) for i in range(6)], "doc_id int, text string")
    asked = []
    monkeypatch.setattr(weighted_minhash, "_verified", lambda pairs, *_: (asked.append(pairs.count()), pairs.limit(0))[1])
    monkeypatch.setattr(weighted_minhash, "components", lambda _: pytest.fail("classes of links that are not there"))
    assert sorted(map(tuple, weighted_minhash.classes(docs).select("doc", "class_id", "n_links", "first").collect())) == [(i, i, 0, True) for i in range(6)]
    assert sum(asked)


@pytest.mark.parametrize("block", [4096, 3])
def test_documents_of_different_classes_meet_once_a_cell_whatever_they_share(spark, monkeypatch, block):
    monkeypatch.setattr(weighted_minhash, "BLOCK", block)
    rng = random.Random(4)
    root = {i: i if i % 5 == 0 else 1 for i in range(1, 24)}
    tokens = {i: set(rng.sample(range(12), 5)) if i % 7 else {100 + i} for i in root}
    kind = "struct<id:long,sig:long>"
    rare = spark.createDataFrame([(t, (i, 0), (root[i], 0)) for i in root for t in tokens[i]], f"token long, id {kind}, root {kind}")
    drawn = {i: [rng.randint(0, 2) for _ in range(6)] for i in root}
    facts = spark.createDataFrame([((i, 0), 10.0, 12.0 if i != 10 else 1.0, drawn[i]) for i in root], f"id {kind}, total double, most double, samples array<int>")
    near = weighted_minhash._near(rare, facts, 0.8, 3)
    got = [tuple(sorted((r.a.id, r.b.id))) for r in near.collect()]

    def alike(a, b):
        return 10 not in (a, b) and sum(x == y for x, y in zip(drawn[a], drawn[b])) >= 3 and root[a] != root[b]

    assert {(a, b) for a in root for b in root if a < b and tokens[a] & tokens[b] and alike(a, b)} <= set(got)
    assert all(alike(a, b) for a, b in got)
    # One row for each order in which two documents of a cell meet, and each class a cell: not one for each shared shingle.
    assert max(got.count(p) for p in got) <= 2 * len(set(root.values()))
    forming = near._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (token" not in forming


def test_many_texts_have_the_shingles_of_each():
    shingle, rng = weighted_minhash.Shingler(5), random.Random(5)
    texts = [rng.choice([None, "", " ", " ".join(rng.choice(["a", "b", "é", "x" * 40, "\n"]) for _ in range(rng.randint(0, 14)))]) for _ in range(300)]
    texts += [" ".join(f"w{i % 50}" for i in range(20_000)), "a b c"]
    at = 0
    for found, counts, begins in shingle.many(texts):
        for a, b in zip(begins[:-1], begins[1:]):
            one, times = shingle(texts[at])
            assert found[a:b].tolist() == one.tolist() and counts[a:b].tolist() == times.tolist()
            at += 1
    assert at == len(texts)
