"""Whitening, near-duplicate vectors and spelling variants against brute force."""

import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from trailhead.llm import product_codes, spelling, whitening
from trailhead.llm.queries import ORACLES, QUERIES

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- whitening ---------------------------------------------------------------------------------------------------------


def expected_whitening(x, k=16):
    fit = np.unique(x, axis=0)
    mean = fit.mean(0)
    centred = fit - mean
    cov = centred.T @ centred / len(fit)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    return fit, values, np.trace(cov), (x - mean) @ vectors / np.sqrt(values)


def test_whitening_query_equals_dense_eigenvectors(spark, sf):
    got = QUERIES["op11_whitening"](spark, sf).toPandas().sort_values(["vec_id", "component"])
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.floor(64 * np.array(rows["embedding"].tolist(), float)) + 1_000_000
    fit, values, trace, z = expected_whitening(x)
    assert list(got.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert got["vec_id"].tolist() == np.repeat(rows["vec_id"].to_numpy(), 16).tolist()
    assert set(got["n"]) == {len(fit)} and got["identity_error"].max() < 1e-9
    np.testing.assert_allclose(got["explained"].to_numpy().reshape(-1, 16)[0], values / trace, rtol=1e-10)
    mine = got["whitened"].to_numpy().reshape(-1, 16)
    np.testing.assert_allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-8)
    sums = [int(s) for s in fit.sum(0)]
    exact = [sum((len(fit) * int(a) - s) ** 2 for a, s in zip(row, sums)) for row in x]
    assert got["deviation"].to_numpy().reshape(-1, 16)[:, 0].tolist() == exact


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = [[float(v) for v in row] for row in rng.standard_normal((40, 6))]
    nan, inf = float("nan"), float("inf")
    rows = [(i, v, 0) for i, v in enumerate(good)]
    rows += [(100, None, 0), (101, [1.0, None, 1.0, 1.0, 1.0, 1.0], 0), (102, [nan] * 6, 0), (103, [inf] * 6, 0), (None, good[0], 0), (0, good[0], 0)]
    rows += [(104, good[3][:4], 0), (105, [], 0)]
    df = spark.createDataFrame(rows, "row long, v array<double>, whitened int")
    model = whitening.fit(df, "v")
    got = whitening.transform(df, model, "v").select("row.row", "row.whitened", "deviation", "whitened").collect()
    kept = [r[1] for r in rows if r[0] not in (100, 101, 102, 103)]
    x = np.floor(64 * np.array([v + [0.0] * (6 - len(v)) for v in kept]))
    fit, values, trace, z = expected_whitening(x)
    assert model.n == len(fit) == 42 and len(got) == len(kept)
    np.testing.assert_allclose(model.values, values, rtol=1e-12)
    mine = np.array([r[3] for r in got])
    np.testing.assert_allclose(mine * np.sign((mine * z).sum(0)), z, atol=1e-9)
    assert sorted(map(str, (r[0] for r in got))) == sorted(str(r[0]) for r in rows if r[0] not in (100, 101, 102, 103))


@pytest.mark.parametrize("rows", [[], [(1, None, 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, [], 0)]])
def test_whitening_without_spread_has_no_components(spark, rows):
    df = spark.createDataFrame(rows, VECTORS)
    model = whitening.fit(df)
    assert len(model.values) == 0
    assert [r.whitened for r in whitening.transform(df, model).collect()] == [[] for r in rows if r[1] is not None]


def test_whitening_of_low_rank_and_large_values(spark):
    rng = np.random.default_rng(2)
    flat = rng.standard_normal((60, 3)) @ rng.standard_normal((3, 40)) * 1e9
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(flat)], "vec_id long, embedding array<double>, label int")
    model = whitening.fit(df)
    assert len(model.values) == 3 and model.identity_error < 1e-6      # what floor() adds is below the least share
    huge = spark.createDataFrame([(1, [1e300, 0.0], 0), (2, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    fit = whitening.fit(huge)
    assert fit.n == 2 and [r.deviation for r in whitening.transform(huge, fit).collect()] == [None, None]


def test_whitening_widens_its_block_when_eigenvalues_are_close(spark):
    rng = np.random.default_rng(3)
    x = np.linalg.qr(rng.standard_normal((400, 80)))[0] * 400
    df = spark.createDataFrame([(i, [float(a) for a in v], 0) for i, v in enumerate(x)], VECTORS)
    model = whitening.fit(df, components=5, guard=2, degree=2)
    scaled = np.floor(64 * x.astype(np.float32).astype(float))
    np.testing.assert_allclose(model.values, expected_whitening(scaled, 5)[1], rtol=1e-10)
    assert model.residual < 1e-11 and model.identity_error < 1e-9


# ---- near-duplicate vectors --------------------------------------------------------------------------------------------


def expected_classes(ids, x, threshold=0.95):
    size = np.linalg.norm(x, axis=1)
    linked = (x @ x.T) / np.outer(size, size) >= threshold
    np.fill_diagonal(linked, False)
    label = np.arange(len(x))
    product_codes._union(label, *np.nonzero(linked))
    least = {p: min(ids[label == p]) for p in set(label)}
    return [(int(i), int(n), int(least[p]), bool(i == least[p])) for i, n, p in zip(ids, linked.sum(1), label)]


def planted(rng, width=16):
    """Loose vectors, chains, a tight group, exact copies and scaled copies."""
    base = rng.standard_normal((150, width))
    tight = base[0] + 0.03 * rng.standard_normal((80, width))
    chain = np.cumsum(np.vstack([base[1], 0.09 * rng.standard_normal((40, width))]), 0)
    copies = np.repeat(base[2:5], 30, 0)
    return np.vstack([base, tight, chain, copies, 3.5 * base[5:15]]).astype(np.float32).astype(float)


@pytest.mark.parametrize("index", [{}, {"tile_rows": 40, "list_rows": 8}, {"reach": 0.7072, "list_rows": 4, "tile_rows": 64}, {"list_rows": 1, "codes": 4}])
def test_vector_classes_equal_all_pairs(spark, index):
    rng = np.random.default_rng(4)
    x = planted(rng)
    ids = rng.permutation(len(x)) - 100
    df = spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x)], VECTORS).repartition(3)
    got = product_codes.classes(df, **index).select("row.vec_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == sorted(expected_classes(ids, x))


def test_vector_classes_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0])]
    same = [(9, [1.0, 0.0]), (9, [1.0, 0.0]), (7, [2.0, 0.0]), (9, [0.0, 1.0]), (8, [1e-200, 1e-250]), (10, [1e300, 1e300])]
    df = spark.createDataFrame(odd + same, "id long, n_links array<double>")
    got = product_codes.classes(df, "id", "n_links").select("row.id", F_first("row.n_links"), "n_links", "component_id", "kept").collect()
    by = sorted(((r[0], r[2], r[3], r[4]) for r in got), key=str)
    assert by == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (None, 0, None, True),
                         (9, 3, 7, False), (9, 3, 7, False), (7, 3, 7, True), (9, 0, 9, True), (8, 3, 7, False), (10, 0, 10, True)], key=str)
    empty = spark.createDataFrame([], VECTORS)
    assert product_codes.classes(empty).count() == 0


def F_first(column):
    from pyspark.sql import functions as F

    return F.col(column).alias("given")


def oracle(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    rel = con.execute(ORACLES[name])
    return [c[0] for c in rel.description], rel.fetchall()


@pytest.mark.parametrize("name", ["op12_product_codes", "op13_spelling"])
def test_queries_equal_their_sql(spark, sf, name):
    columns, want = oracle(spark, sf, name)
    got = QUERIES[name](spark, sf)
    assert got.columns == columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


# ---- spelling ----------------------------------------------------------------------------------------------------------

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected_words(docs, every=31, least=7, count=2):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            if len(run) >= least:
                n[run] += 1
    return {w: c for w, c in n.items() if c >= count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_groups(n, ratio=10):
    around = {w: [v for v in n if abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= ratio * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted(((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n), key=str)


def test_spelling_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(5)
    letters = list("abcAé×")
    words = ["".join(rng.choice(letters, rng.integers(7, 10))) for _ in range(250)]
    for w in list(words):
        at = int(rng.integers(0, len(w)))
        words += [w[:at] + w[at + 1:], w[:at] + "b" + w[at:], w[:at] + "c" + w[at + 1:]]
    chain = ["aaaaaaabbb"] * 300 + ["aaaaaaabbc"] * 25 + ["aaaaaaabcc"] * 2 + ["aaaaaaa"] * 40 + ["aaaaaaaa"] * 4 + ["aaaaaaaaa"] * 2
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)] + [" ".join(chain)]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "Wörterbuch wörterbuch"), (900, None), (901, ""), (902, "kürzer, 12345678")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, word int, n string")
    n = expected_words(docs)
    assert len(n) > 300
    for letters in (200_000, 60):
        got = spelling.group(spelling.vocabulary(df, slip_every=31), piece_letters=letters).collect()
        assert sorted(map(tuple, got), key=str) == expected_groups(n)


def test_spelling_of_long_words_and_empty_tables(spark):
    long = "ab" * 20_000
    docs = [(1, f"{long} {long} {long[:-1]} {long[:-1]} {'c' + long[1:]} {'c' + long[1:]}")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.word: (r.n, r.n_near, r.form) for r in spelling.group(spelling.vocabulary(df)).collect()}
    assert got == {long: (2, 2, None), long[:-1]: (2, 1, None), "c" + long[1:]: (2, 1, None)}
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group(spelling.vocabulary(none, slip_every=31)).count() == 0


def test_index_walk_finds_the_words_one_edit_away():
    rng = np.random.default_rng(6)
    words = sorted({"".join(rng.choice(list("ab"), n)) for n in (5, 6) for _ in range(40)})
    index = spelling.Index(words, 5, 0)
    for w in (w for w in words if len(w) == 5):
        replaced, longer = index.near(w)
        assert [words[j] for j in spelling.members(replaced | longer)] == [v for v in words if near(w, v)]
