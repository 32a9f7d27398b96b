"""Quality rules, URL rules, BPE and line dedup against brute force and the odd inputs they define."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trailhead.llm import bpe, lexicon, line_dedup, queries, quality, url_rules

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def test_word_counts_match_brute_force(spark, sf):
    got = queries.QUERIES["op1_line_labels"](spark, sf).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        words, seen, dup = WORDS.findall(r.text), set(), 0
        for line in r.text.split("\n"):
            if WORDS.search(line):
                dup += line in seen
                seen.add(line)
        grams = Counter(zip(words, words[1:], words[2:]))
        covered = {j for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for j in range(i, i + 3)}
        row = got.loc[r.doc_id]
        want = (len(words), sum(map(len, words)), sum(r.text.count(c) for c in "#*$%&|<>"), dup, len(covered))
        assert tuple(row[["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]]) == want
        assert row.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (row.base_failed and row.kept)


def test_field_separates_held_out_documents(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    field = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    rest = quality.assess(docs.join(labels.where("doc_id % 2 = 1"), "doc_id"), field).where("not base_failed")
    rows = rest.select("row.quality", "kept").collect()
    assert sum(r.kept == bool(r.quality) for r in rows) >= 0.95 * len(rows)


def test_viterbi_is_the_best_labelling():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    field = quality.LineField(rng.normal(size=(len(quality.FEATURES), 2)), rng.normal(size=(2, 2)))
    codes = [int(x) for x in rng.integers(0, 1 << len(quality.FEATURES), 7)]
    emit = [quality.LineField.bits(np.array(c)) @ field.emit for c in codes]

    def score(labels):
        return sum(e[y] for e, y in zip(emit, labels)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))

    assert tuple(field.viterbi(codes)) == max(itertools.product((0, 1), repeat=7), key=score)


def test_quality_defined_cases(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "a " * 60, "z"), (3, " ".join(f"w{i}" for i in range(60)), "z"), (3, " ".join(f"w{i}" for i in range(60)), "z")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, kept string").withColumn("key", F.lit("k"))       # clashing names
    labels = spark.createDataFrame([], "doc_id int, quality int")
    got = [(r.row.doc_id, r.n_words, r.kept) for r in quality.assess(docs, quality.fit(docs, labels)).collect()]
    assert sorted(got, key=str) == sorted([(1, 0, False), (None, 0, False), (2, 60, False), (3, 60, True), (3, 60, True)], key=str)
    assert quality.assess(docs.limit(0), quality.LineField.neutral()).count() == 0


def test_url_rules_pick_the_longest(spark):
    rules = [("net", "/", "block"), ("a.net", "/x", "allow"), ("a.net", "/x/y", "block"), ("b.a.net", "/", "allow"), ("a.net", "/x", "block"), ("", "/", "block"), (None, "/", "block")]
    urls = [None, "no scheme", "http://A.net", "http://a.net/", "http://a.net/x", "https://c.a.net/x/yz?q=/x", "http://b.a.net/x/y#f", "http://xa.net/x",
            "http://a.net.org/x", "http://a.net/x", "x://net/", "http://b.a.net/q://z.net/", "http://.net/"]
    frame = spark.createDataFrame([(i, u, "old") for i, u in enumerate(urls)] + [(3, urls[3], "old")], "id int, url string, rule string")
    got = url_rules.apply_rules(frame, spark.createDataFrame(rules, "host string, path string, action string")).collect()

    def brute(u):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fit = [(len(h + p), len(h), h + p, a) for h, p, a in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=(0, 0, None, "allow"))
        return host, path, best[2], best[3]

    assert len(got) == len(urls) + 1
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url


def test_lexicon_round_trip(tmp_path):
    random.seed(3)
    for n in (0, 1, 300):
        words = sorted({bytes(random.choice(b"abc") for _ in range(random.randint(1, 7))) for _ in range(n)})
        entries = {w: tuple(random.randint(0, 3) for _ in range(random.randint(1, 4))) for w in words}
        path = tmp_path / f"{n}.bin"
        path.write_bytes(lexicon.build(entries.items()))
        read = lexicon.Lexicon(str(path))
        assert all(read.get(w) == list(ids) for w, ids in entries.items())
        assert read.get(b"zz") is None and read.get(b"") is None
        asked = words + [b"zz", b"", b"a" * 9, b"abcabcabcabc", b"a"]
        side_by_side = [None if ids is None else memoryview(ids).cast("i").tolist() for ids in read.get_all(asked, longest=8)]
        assert side_by_side == [read.get(w) for w in asked]


def test_words_merged_side_by_side_equal_single_ones():
    vocabulary = bpe.Vocabulary(queries.byte_bpe_50k())
    random.seed(11)
    words = ["".join(random.choice("etaoin shrdlu'é世") for _ in range(random.randint(1, 30))).encode() for _ in range(2000)]
    words += [b"a", b"\xff", b"the" * 40, b" " * 48]
    assert [memoryview(ids).cast("i").tolist() for ids in vocabulary.merge_all(words)] == [vocabulary.merge(w) for w in words]
    assert vocabulary.merge_all([]) == []


def test_texts_are_cut_like_the_pattern():
    random.seed(12)
    for text in ["a\n \nb", "a \nb", "a ", "a\n ", " a", "\n a", "\t \t ", "\u3000 x", *(
            "".join(random.choice([" ", "\n", "\t", "a", "'s", "1", "é", ".", "\0"]) for _ in range(random.randint(0, 12))) for _ in range(3000))]:
        cut = bpe.pieces(text)
        assert "".join(cut) == text
        assert [w for piece in cut for w in bpe.words_of(piece)] == bpe._cutter()[0].findall(text)


def test_bpe_equals_the_library(spark, sf):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.byte_bpe_50k()
    theirs = tokenizers.Tokenizer.from_file(path)
    random.seed(1)
    marks = list(" \n\t  \r\x1c\x85\xa0\u3000'srtlmdAB01²é世🙂-.,!_\u200b\0") + ["<|endoftext|>", "  ", " the", "x" * 60]
    texts = ["".join(random.choice(marks) for _ in range(random.randint(0, 14))) for _ in range(400)] + [None, "", "ab" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").unionByName(
        spark.read.parquet(f"{sf}/documents.parquet").select((F.col("doc_id") + 1000).cast("int").alias("doc_id"), "text"))
    done = bpe.decode(bpe.encode(docs, path, decoded="same"), path)
    for r in done.select("row.text", "ids", "decoded", "same").collect():
        ids = theirs.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == ids
        assert r.decoded == r.same == theirs.decode(ids, skip_special_tokens=False) == (r.text or "")
    assert bpe.encode(docs.limit(0), path).count() == 0
    small = bpe.encode(docs, path, memo_bytes=1, decoded="same").select("row.text", "ids", "same").collect()    # nothing is kept at hand
    assert all(list(r.ids) == theirs.encode(r.text or "", add_special_tokens=False).ids and r.same == (r.text or "") for r in small)


def test_bpe_query_on_repeats_and_clashing_names(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(queries.byte_bpe_50k())
    rows = [(1, "one  two <|endoftext|> three", 1, "x"), (1, "one  two <|endoftext|> three", 1, "x"), (2, None, 2, None), (None, "", 3, "y"), (3, "z" * 70_000, 4, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, ids int, row string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((r.ids, r.row or "") for r in bpe.encode(docs, queries.byte_bpe_50k()).select("row.ids", "row.row").collect()) == [
        (1, "x"), (1, "x"), (2, ""), (3, "y"), (4, "")]

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    want = []
    for doc_id, text, *_ in rows:
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        want.append((doc_id, len(ids), sha(",".join(map(str, ids))), sha(theirs.decode(ids, skip_special_tokens=False))))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op4_bpe"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def brute_lines(docs):
    whole, cuts, places, gone = set(), set(), set(), {}
    for key, text in docs:
        for no, line in enumerate(text.split("\n")):
            w = tuple(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)
            if len(w) < 5:
                continue
            shorter = [w[:i] + w[i + 1:] for i in range(len(w))]
            same = [(len(w), i, x) for i, x in enumerate(shorter)]
            if w in whole or w in cuts or any(x in whole for x in shorter) or any(x in places for x in same):
                gone.setdefault(key, []).append(no)
            whole.add(w)
            cuts.update(shorter)
            places.update(same)
    return gone


def test_line_dedup_matches_brute_force(spark, sf):
    random.seed(7)
    base = [[random.choice("a b c d e f g h".split()) for _ in range(random.randint(5, 12))] for _ in range(40)]

    def edited(words):
        w, i = list(words), random.randrange(len(words))
        w[i:i + random.choice((0, 1))] = random.choice(([], ["x"], ["y", "z"]))
        return " ".join(w)

    docs = [(i, "\n".join(edited(random.choice(base)) for _ in range(random.randint(1, 6)))) for i in range(60)]
    docs += [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = line_dedup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).select("row.doc_id", "removed", "kept").collect()
    want = brute_lines(sorted(docs))
    texts = dict(docs)
    for r in got:
        assert list(r.removed) == want.get(r.doc_id, [])
        assert r.kept == "\n".join(x for i, x in enumerate(texts[r.doc_id].split("\n")) if i not in set(r.removed))


def test_line_dedup_defined_cases(spark):
    rows = [(1, "a b c d e", 5), (1, "a b c d e", 6), (None, "a b c d e x", 7), (2, None, 8), (3, "", 9), (4, "a b c X e\n\na c d e\n  a  b c d e", 1), (5, "z " * 3000, 2)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, removed int")
    got = {(r.doc_id, r.mine): (r.n_lines, r.removed, r.kept) for r in line_dedup.dedup(docs).select(
        "row.doc_id", F.col("row.removed").alias("mine"), "n_lines", "removed", "kept").collect()}
    assert got[1, 5] == got[1, 6] == (1, [], "a b c d e")
    assert got[None, 7] == (1, [0], "") and got[2, 8] == (0, [], None) and got[3, 9] == (1, [], "")
    assert got[4, 1] == (4, [0, 3], "\na c d e")
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_short_lines_go_when_equal(spark, tmp_path):
    rows = [(1, "Read more\n\nx\nAll rights reserved."), (2, "Read  more\n\nRead this more\nAll rights kept.\nx"), (None, "x\nRead more")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.removed for r in queries.QUERIES["op8_line_dedup"](spark, str(tmp_path)).collect()}
    assert got == {1: [], 2: [0, 4], None: [0, 1]}
