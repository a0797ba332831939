"""Whitening, vector codes and URL filters against plain versions."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from metaloom.llm import codes, urls, whitening
from metaloom.llm.queries import R
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, dim int, n long, code string, error long, matrix string"


@pytest.fixture(scope="module")
def vectors(spark):
    """Makes an embeddings table from (vec_id, embedding, label) rows, with extra columns of awkward names."""

    def make(rows):
        return spark.createDataFrame([(*r, 1, 2, "c", 3, "m") for r in rows], SCHEMA)

    return make


def sample(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return [(int(i), [float(np.float32(x)) for x in rng.standard_normal(dim) * np.linspace(1, 0.2, dim)], int(i) % 3) for i in range(n)]


ODD = [(900, None, 1), (901, [], 1), (902, [float("nan")] * 6, 1), (903, [None] + [1.0] * 5, 1), (904, [float("inf")] + [1.0] * 5, None), (905, [1.0, 2.0], 2)]


def whole(rows, scale):
    return [[math.floor(scale * x) for x in v] for _, v, _ in rows]


def test_whitening_equals_eigenvectors(vectors):
    rows = sample(120, 6)
    rows += [rows[5], (None, rows[7][1], None)]
    shuffled = rows + ODD
    random.Random(1).shuffle(shuffled)
    got = whitening.whiten(vectors(shuffled), components=4).collect()
    assert len(got) == 4 * len(rows)
    x = np.array(whole(rows, 64), dtype=object) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    centred = (x * n - s).astype(float) / n
    v = centred.T @ centred / n
    values, vecs = np.linalg.eigh(v)
    values, vecs = values[::-1], vecs[:, ::-1]
    white = centred @ vecs / np.sqrt(values)
    for c in range(1, 5):
        mine = sorted(((-1 if r.vec_id is None else r.vec_id), r.whitened, r.deviation, r.explained, r.n, r.identity_error) for r in got if r.component == c)
        want = sorted((-1 if i is None else i, w, d) for (i, _, _), w, d in zip(rows, white[:, c - 1], deviation))
        sign = np.sign(mine[3][1] * want[3][1])
        for m, w in zip(mine, want):
            assert m[0] == w[0] and m[2] == w[2] and m[4] == n and m[5] < 1e-9
            assert m[1] * sign == pytest.approx(w[1], abs=1e-9) and m[3] == pytest.approx(values[c - 1] / values.sum(), rel=1e-9)


@pytest.mark.parametrize("spectrum", [np.r_[1e6, 1e3, np.ones(60)], np.geomspace(1, 1e-12, 80), np.arange(1.0, 201), np.ones(70), np.r_[np.ones(4), np.zeros(70)], np.zeros(60)])
def test_components_are_certified(spectrum):
    dim = len(spectrum)
    q = np.linalg.qr(np.random.default_rng(2).standard_normal((dim, dim)))[0]
    v = (q * spectrum) @ q.T
    values, vecs = whitening.leading_components(lambda m: v @ m, dim)
    assert np.abs(values - np.sort(spectrum)[::-1][:32]).max() <= 1e-12 * max(spectrum.max(), 1)
    assert np.abs(vecs.T @ vecs - np.eye(vecs.shape[1])).max() < 1e-12
    assert np.abs(v @ vecs - vecs * values).max() <= 1e-9 * max(spectrum.max(), 1e-300)


def test_whitening_odd_tables(vectors):
    assert whitening.whiten(vectors([])).count() == whitening.whiten(vectors(ODD[:5])).count() == 0
    alone = whitening.whiten(vectors([(1, [1.0, 2.0], 0)])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in alone] == [(1, 1, 0, None, 0.0, None), (2, 1, 0, None, 0.0, None)]
    far = whitening.whiten(vectors([(1, [3e38], 0), (2, [-3e38], 0)])).collect()
    assert [r.deviation for r in far] == [None, None] and sorted(round(r.whitened, 9) for r in far) == [-1.0, 1.0]


def plain_codes(rows, rounds=6):
    kept = sorted(((math.inf if i is None else i), v, label) for i, v, label in rows)
    size = -(-len(kept[0][1]) // 8)
    parts = [[(v + [0] * (size * 8))[p * size : (p + 1) * size] for p in range(8)] for v in ([math.floor(4096 * x) for x in r[1]] for r in kept)]
    books = [[row[p] for row in parts[:16]] for p in range(8)]

    def assign(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(8):
            cells = {}
            for row in parts:
                cells.setdefault(assign(row[p], books[p])[1], []).append(row[p])
            for k, members in cells.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members)]
    out = []
    for (i, _, label), row in zip(kept, parts):
        found = [assign(row[p], books[p]) for p in range(8)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = {}
    for _, label, _, e in out:
        sums[label] = sums.get(label, 0) + e
    return sorted((i, c, e, sums[label], digest) for i, label, c, e in out)


@pytest.mark.parametrize("rows", [
    sample(90, 24) + [(3, sample(90, 24)[3][1], 0), (None, sample(1, 24, 9)[0][1], None), (7, sample(1, 24, 5)[0][1], None)],
    sample(60, 10),
    sample(5, 8),
    [(i, [float(i % 3)] * 8, 0) for i in range(50)],
    [(i, [(-1.0) ** i * 1e30 * (i % 5)] + [float(i)] * 7, i % 2) for i in range(40)],
], ids=["usual", "filled", "few", "ties", "huge"])
def test_codes_equal_plain_training(vectors, rows):
    limit = 2.0**53 / 4096
    got = sorted(((math.inf if r.vec_id is None else r.vec_id), r.code, int(r.error), int(r.label_error), r.codebooks_sha256) for r in codes.compress(vectors(rows + ODD)).collect())
    assert got == plain_codes([(i, [max(-limit, min(limit, x)) for x in v], label) for i, v, label in rows])


def test_pivot_bounds_leave_fewer_distances():
    rng = np.random.default_rng(3)
    points, entries = (rng.integers(-1000, 1000, (n, 8)) for n in (500, 16))
    pivots = codes.choose_pivots(entries)
    code, apart, evaluated = codes.nearest(points, codes.pivot_distances(points, pivots), entries, codes.pivot_distances(entries, pivots))
    every = ((points[:, None] - entries[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (apart == every.min(axis=1)).all() and evaluated < 500 * 12


def test_codes_odd_tables(vectors):
    assert codes.compress(vectors([])).count() == codes.compress(vectors(ODD[:5])).count() == 0


def plain_verdicts(pages, rules, listed):
    out = []
    for i, url in pages:
        found = re.match("(?s).*?://([^/?#]*)([^?#]*)", url or "")
        host, path = found.groups() if found else ("", "")
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)

        def fits(entry):
            h, slash, rest = entry.partition("/")
            return (host == h or host.endswith("." + h)) and path.startswith(slash + rest)

        rule, verdict = max(((r, v) for r, v in rules if fits(r)), key=lambda x: (len(x[0]), x[0], x[1] == "block"), default=(None, "block" if any(map(fits, listed)) else "allow"))
        out.append((i if i is not None else -1, host, path, rule, verdict))
    return sorted(out, key=str)


PAGES = [
    (1, None), (2, ""), (3, "no scheme"), (4, "http://Example.NET/en/1"), (5, "http://example.net"), (6, "x://a.example.com/de/?q"), (7, "x://org/fr/"), (8, "x://notorg/fr/"), (9, "x://a.org/fr"),
    (10, "x://free-bets.example.com/a"), (11, "x://m.free-bets.example.com/en/9#t"), (12, "x://casino-win.example.net/en/1"), (13, "x://spam-farm.example.org/fr/2"), (14, "x://É.NET/ü"), (15, "x://a.b/c://d.net/"),
    (16, "x://" + "a." * 50_000 + "net/" + "p" * 100_000), (17, "x://" + "w" * 1_000_000), (18, "y" * 1_000_000), (None, "x://q.net/"), (4, "http://Example.NET/en/1"), (19, "x://.net/"), (20, "x://net./"), (21, "x://long.list.test/a/b/c"), (22, "x://user@h.net:80/"),
    (23, "x://a.net\n/en/"),
]


@pytest.mark.parametrize("array_bytes", [urls.ARRAY_BYTES, 0])
def test_verdicts_equal_plain_matching(spark, array_bytes):
    pages = spark.createDataFrame([(i, u, "h", "r", 1) for i, u in PAGES], "page_id long, url string, host string, rule string, n int")
    rules = [*urls.RULES, ("list.test/a/", "allow"), ("list.test/a/b", "block"), ("same.test/", "allow"), ("same.test/", "block"), ("b", "block")]
    listed = [*urls.LISTED, "long.list.test", "net"]
    got = urls.judge_urls(pages, rules, listed, array_bytes=array_bytes).collect()
    assert sorted(((r.page_id if r.page_id is not None else -1, r.host, r.path, r.rule, r.verdict) for r in got), key=str) == plain_verdicts(PAGES, rules, listed)
    assert urls.judge_urls(pages.limit(0), array_bytes=array_bytes).count() == 0
    assert urls.judge_urls(pages, [], []).where("verdict = 'block' OR rule IS NOT NULL").count() == 0


def test_equal_digests_are_told_apart(spark, monkeypatch):
    array = urls.DigestArray("none", 0)
    assert array.find([b"a"]) == [[]]
    texts = [b"one", b"two", b"three"]
    array.keys, array.kinds = np.array([7, 7, 9], np.uint64), np.array([0, 1, 2], np.uint8)
    array.texts, array.ends = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([3, 3, 5])
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda t, seed: {b"one": 7, b"two": 7, b"other": 7}.get(t, 9))
    assert array.find([b"one", b"two", b"other", b"three"]) == [[0], [1], [], [2]]


def test_array_is_cut_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(urls, "SHARD_ROWS", 50)
    listed = [f"h{i}.test/" for i in range(500)]
    pages = spark.createDataFrame([(i, f"x://h{i}.test/p") for i in range(0, 1000, 3)], "page_id long, url string")
    assert {r.page_id for r in urls.judge_urls(pages, [], listed).where("verdict = 'block'").collect()} == set(range(0, 500, 3))


@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_url_filters"])
def test_queries_equal_sql(spark, name):
    ok, note, _ = compare(spark, connect(SF), name, R.builders[name], R.sql[name], SF)
    assert ok, note
