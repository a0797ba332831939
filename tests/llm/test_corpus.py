"""Secrets, leaks, lines, SimHash and quality against plain versions."""

import collections
import itertools
import math
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from metaloom.llm import decontaminate, lines, quality, secrets, simhash
from metaloom.llm.common import components
from metaloom.llm.queries import R
from tests.llm.conftest import PROSE
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_secret_scan_equals_sql(spark):
    ok, note, _ = compare(spark, connect(SF), "op1_secret_scan", R.builders["op1_secret_scan"], R.sql["op1_secret_scan"], SF)
    assert ok, note


def test_secret_spans(table):
    key = "aB3dE5gH7jK9mN1pQ4sT"
    rows = [
        (1, 'é token="abcdefghijkl" x'), (2, "secret: token: abcdefghijklmnop"), (3, "AKIA" + "A" * 14 + " AKIA" + "B" * 13), (4, "deadbeefdeadbeef0 beef"),
        (5, f"id {key} end"), (6, "thisisaverylongwordindeedyes"), (7, None), (8, "API_KEY = 'zzzzzzzzzzzz'"), (9, "0123456789abcdef0123456789abcdef01234567"),
    ]
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan_secrets(table(rows)).collect()}
    assert got[1] == (1, 0, 0, "assign:2:21")
    assert got[2][:3] == (0, 0, 0)
    assert got[3] == (0, 1, 0, "access:0:18")
    assert got[4] == (0, 0, 1, "hex:0:17")
    assert got[5] == (0, 0, 0, f"entropy:3:{3 + len(key)}")
    assert got[6] == got[7] == (0, 0, 0, "")
    assert got[8] == (1, 0, 0, "assign:0:23")
    assert got[9] == (0, 0, 1, "hex:0:40")  # an allowed run adds no entropy span


def test_window_entropy_equals_counting(spark):
    rnd = random.Random(4)
    runs = ["".join(rnd.choice("abcdefABCDEF0123456789+/_-") for _ in range(rnd.randrange(20, 60))) for _ in range(50)] + ["a" * 25]
    df = spark.createDataFrame([(r,) for r in runs], "run string")
    for r in df.select("run", secrets.least_window_weight(df["run"]).alias("least")).collect():
        want = min(sum(secrets.WEIGHTS[c] for c in collections.Counter(r.run[i : i + 20]).values()) for i in range(len(r.run) - 19))
        assert r.least == want


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"hex": DIGITS + "abcdef", "base32": UPPER + "234567", "base36": DIGITS + LOWER, "base64": DIGITS + LOWER + UPPER + "+/", "base64url": DIGITS + LOWER + UPPER + "_-"}


@pytest.mark.parametrize("size,least", [(12, 0.78), (16, 0.88), (20, 0.9), (32, 0.95), (40, 0.95)])
def test_random_keys_are_found(table, size, least):
    rnd = random.Random(size)
    keys = [(name, "".join(rnd.choice(letters) for _ in range(size))) for name, letters in ALPHABETS.items() for _ in range(200)]
    found = collections.Counter()
    for r in secrets.scan_secrets(table([(i, f"key {k} end") for i, (_, k) in enumerate(keys)])).collect():
        found[keys[r.doc_id][0]] += f"entropy:4:{4 + size}" in r.spans
    assert all(found[name] >= least * 200 for name in ALPHABETS), found


def test_words_and_numbers_are_no_secrets(table):
    plain = "internationalization getElementByIdentifier snake_case_words_everywhere how-to-make-a-cake-in-2023 2023-05-17 +49-30-1234567 a/path/to/some/file 123456789012345 SCREAMING_SNAKE_CASE"
    assert [r.spans for r in secrets.scan_secrets(table([(1, plain)])).collect()] == [""]


def test_limits_of_random_windows():
    rnd = random.Random(1)
    for letters, n in ((16, 12), (36, 20), (64, 20)):
        bits = [math.log2(n) - sum(c * math.log2(c) for c in collections.Counter(rnd.choices(range(letters), k=n)).values()) / n for _ in range(4000)]
        mean, deviation = secrets.random_bits(letters, n)
        assert abs(np.mean(bits) - mean) < 0.02 and abs(np.std(bits) - deviation) < 0.02


ITEM = "In the town of Arlen a baker named Morris sold 45 loaves of bread for 3 dollars each and Morris kept 45 more for the next day"


def test_leaks(spark, table):
    bench = spark.createDataFrame([(10, ITEM, 1), (11, None, 1), (12, "", 1), (13, "too short item", 1)], "item_id long, text string, words int")
    reworded = ITEM.replace("Morris", "Felix").replace("45", "77").replace("Arlen", "Selby")
    mixed = ITEM.replace("Morris kept 45", "Felix kept 46")
    clashing = ITEM.replace("named Morris", "named Felix").replace("sold 45", "sold 46").replace("3 dollars", "5 dollars")  # 11 windows to the value
    rows = [(1, f"start of it. {ITEM}. And more text."), (2, f"before {reworded} after"), (3, f"before {mixed} after"), (9, f"before {clashing} after"), (4, PROSE), (5, None), (6, ""), (7, " ".join(ITEM.split()[:10]) + " " + PROSE), (8, "this is too short item here"), (1, f"start of it. {ITEM}. And more text.")]
    got = decontaminate.mark_contaminated(table(rows), bench).collect()
    assert len(got) == len(rows)
    found = {r.doc_id: (r.contaminated, r.items, r.reworded) for r in got}
    assert found[1] == (True, [10], False)
    assert found[2] == (True, [10], True)
    assert found[3] == (True, [10], True)  # nineteen words of the item to the letter
    assert found[9] == (False, [], False)  # one name or number cannot stand for two
    assert not any(found[i][0] for i in (4, 5, 6, 7))
    assert found[8] == (True, [13], False)
    assert sorted(r.doc_id for r in decontaminate.drop_contaminated(table(rows), bench).collect()) == [4, 5, 6, 7, 9]
    assert decontaminate.mark_contaminated(table(rows), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark_contaminated(table([]), bench).count() == 0


def test_leaks_with_decimals_and_units(spark, table):
    texts = ["Convert 3.5 km to miles", "Pay 1,000 dollars at 2.5% by 12:30 h", "It took 3 h and 1/2 m or 7.25 in all"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    both = df.select(decontaminate.template_words(df["text"], False).alias("a"), decontaminate._templates(decontaminate.template_words(df["text"], True)).alias("b")).collect()
    assert all(r.a == r.b for r in both)
    n, u = decontaminate.NUMBER, decontaminate.UNIT
    assert both[0].a == ["convert", n, u, "to", "miles"]
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "item_id long, text string")
    rows = [(i, f"he said: {t} . and left") for i, t in enumerate(texts)] + [(9, "Convert 3 km to miles")]
    got = {r.doc_id: (r["items"], r.reworded) for r in decontaminate.mark_contaminated(table(rows), bench).collect()}
    assert got == {0: ([0], False), 1: ([1], False), 2: ([2], False), 9: ([0], True)}


def test_leaks_with_values_that_clash(spark, table):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray yankee zulu amber birch".split()
    twice = " ".join([*words[:4], "45", *words[4:12], "45", *words[12:]])  # thirty words, one number twice
    run = "we then saw that the old mill by the green lake had been shut for many long years and so 17 crows sat on 17 posts in rows of two by the gate"
    two = "a shop with 45 red hats and 12 blue caps was open all day and then sold the last of them"
    bench = spark.createDataFrame([(1, twice), (2, run), (3, two)], "item_id long, text string")
    rows = [
        (1, " ".join([*words[:4], "45", *words[4:12], "46", *words[12:]])),  # 21 of 26 windows to the value
        (2, run.split(" 17 crows")[0] + " 5 dogs ran off 6 posts into the dark of the night over there"),  # twenty words, then other text with a clashing number at a slot
        (3, two.replace("45", "7").replace("12", "7")),
        (4, PROSE),
    ]
    got = {r.doc_id: (r["items"], r.reworded) for r in decontaminate.mark_contaminated(table(rows), bench).collect()}
    assert got == {1: ([1], True), 2: ([2], True), 3: ([3], True), 4: ([], False)}


def test_leaks_with_words_put_in(spark, table):
    words = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango uniform victor whiskey xray".split()
    put_in = [*words[:12], "also", *words[12:]]  # 16 of 20 windows on two lines
    price = "a shop sold 45 red hats for 3 dollars each and 12 blue caps to those who had come in late that day before it was shut for good"
    bench = spark.createDataFrame([(1, " ".join(words)), (2, price)], "item_id long, text string")
    far = " ".join([*words[:12], *["filler"] * 60, *words[12:]])
    rows = [(1, " ".join(["so", *put_in, "end"])), (2, price.replace("3 dollars", "$3")), (3, far), (4, " ".join(words[:9])), (None, " ".join(put_in))]
    got = {r.doc_id: (r["items"], r.share, r.reworded) for r in decontaminate.mark_contaminated(table(rows), bench).collect()}
    assert got[1] == got[None] == ([1], 0.8, False)
    assert got[2][0] == [2] and not got[2][2]
    assert got[3][0] == got[4][0] == []


def test_leaks_equal_plain_containment(spark):
    sf = "/root/testdata/sf0.01"
    got = R.builders["op3_benchmark_decontamination"](spark, sf).toPandas()
    items = [" ".join(t.split())[:-1] for (t,) in duckdb.sql(f"SELECT text FROM '{sf}/benchmark.parquet'").fetchall()]
    want = {d for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall() if any(i in " ".join(t.split()) for i in items)}
    assert set(got[got.contaminated].doc_id) == want and want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, text, n):
    letters = list(text)
    for _ in range(n):
        i = rnd.randrange(len(letters))
        kind = rnd.randrange(3)
        if kind == 0:
            letters.insert(i, rnd.choice("abé"))
        elif kind == 1 and len(letters) > 1:
            del letters[i]
        else:
            letters[i] = rnd.choice("abc")
    return "".join(letters)


def test_banded_edits_equal_dynamic_programming():
    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 12)))
        b = edited(rnd, a, rnd.randrange(4))
        for edits in range(4):
            assert lines.within_edits(a, b, edits) == (distance(a, b) <= edits), (a, b, edits)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_near_lines_share_a_key(edits):
    rnd = random.Random(edits)
    for _ in range(500):
        a = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(24, 40)))
        a, b = sorted((a, edited(rnd, a, edits)), key=len)
        index, probe = lines.key_columns([a], edits, False), lines.key_columns(["zzz", b], edits, True)
        assert set(index[0].tolist()) & set(probe[0].tolist())
        assert ((int(index[2][0]) ^ int(probe[2][-1])) & (1 << 64) - 1).bit_count() <= 2 * edits or a == b


def test_line_dedup_equals_brute_force(table):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randrange(22, 40))).strip() + "x" * 4 for _ in range(25)]
    rows = []
    for i in range(60):
        own = [edited(rnd, rnd.choice(base), rnd.randrange(3)) for _ in range(rnd.randrange(6))]
        rows.append((i, "\n".join([*own, "short", "short"])))
    rows += [(61, None), (62, ""), (None, base[0] + "\n" + base[0])]
    got = {r.doc_id: r.text for r in lines.dedup_lines(table(rows)).collect()}
    every = [(i is not None, i, n, s) for i, t in rows if t for n, line in enumerate(t.split("\n")) if len(s := line.strip()) >= lines.SHORTEST]
    every.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
    distinct = sorted({s for *_, s in every})
    group = {s: s for s in distinct}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for a, b in itertools.combinations(distinct, 2):
        if distance(a, b) <= lines.EDITS:
            group[root(a)] = root(b)
    first, want = {}, collections.defaultdict(set)
    for _, i, n, s in every:
        if first.setdefault(root(s), (i, n)) != (i, n):
            want[i].add(n)
    for i, t in rows:
        assert got[i] == (t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in want[i])), i
    assert sum(map(len, want.values())) > 20


@pytest.mark.parametrize("few", [3, 64])
def test_lines_of_a_template_equal_brute_force(table, monkeypatch, few):
    """Keys that many lines share are split until few are left; the components are those of all pairs."""
    monkeypatch.setattr(lines, "FEW", few)
    rnd = random.Random(few)
    made = {f"Invoice number {rnd.randrange(2000):06d} was paid on time" for _ in range(70)}
    made |= {f"Order {rnd.randrange(40)} of client {rnd.randrange(10 ** rnd.randrange(1, 5))} is ready" for _ in range(70)}
    made |= {edited(rnd, "aaaaaaaaaaaaaaaaaaaaaaab", rnd.randrange(9)) for _ in range(40)}
    made |= {edited(rnd, rnd.choice(sorted(made)), rnd.randrange(4)) for _ in range(60)}
    made = sorted(m for s in made if len(m := s.strip()) >= lines.LINKED)
    got = {r.node: r.root for r in lines.components(lines.near_lines(table([(i, m) for i, m in enumerate(made)]))).collect()}
    group = {m: m for m in made}

    def root(s):
        while group[s] != s:
            s = group[s]
        return s

    for a, b in itertools.combinations(made, 2):
        if abs(len(a) - len(b)) <= lines.EDITS and distance(a, b) <= lines.EDITS:
            group[root(a)] = root(b)
    want = collections.defaultdict(set)
    for m in made:
        want[root(m)].add(lines.line_id(m))
    have = collections.defaultdict(set)
    for node, end in got.items():
        have[end].add(node)
    assert {frozenset(g) for g in want.values() if len(g) > 1} == {frozenset(g) for g in have.values()}
    assert max(map(len, want.values())) > few


def test_short_lines_go_by_equality_only(table):
    rows = [(1, "Share this\n\n  \nRead more\nx"), (2, " Share this \n\nRead mors\n共有する\nx"), (3, "共有する\nown\nx"), (4, "Read more")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup_lines(table(rows)).collect()}
    assert got == {1: (rows[0][1], 0), 2: ("\nRead mors\n共有する", 2), 3: ("own", 2), 4: ("", 1)}


def test_segment_table_covers_a_line():
    for edits in (1, 2, 3):
        for length in range(20, 60):
            parts = [lines.segment(np.array([length]), i, edits) for i in range(edits + 1)]
            at = 0
            for start, size in parts:
                assert start[0] == at
                at += size[0]
            assert at == length


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    """Smallest id reachable by links of four bits or fewer, for (id, fingerprint) rows."""
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, a), (j, b) in itertools.combinations(prints, 2):
        if (a ^ b).bit_count() <= 4:
            x, y = sorted((find(i), find(j)))
            root[y] = x
    return {i: find(i) for i, _ in prints}


def test_simhash_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [(i, plain_fingerprint(t)) for i, t in rows]
    want = linked(prints)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()} == {i: (f"{f:016x}", want[i]) for i, f in prints}


def test_links_of_crafted_fingerprints(spark):
    rnd = random.Random(6)
    prints = []
    for _ in range(12):
        center = rnd.getrandbits(64)
        for _ in range(12):
            f = center
            for bit in rnd.sample(range(64), rnd.randrange(6)):
                f ^= 1 << bit
            prints.append(f)
    prints = sorted(set(prints))
    signed = [f - (1 << 64) if f >> 63 else f for f in prints]
    got = {r.fp: r.root for r in simhash.link_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()}
    want = linked(list(zip(signed, prints, strict=True)))
    pairs = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert pairs(got) == pairs(want)


def test_golay_indices_meet_within_two_bits():
    _, _, table = simhash.code_tables()
    words = table[:, :1].ravel()
    own = simhash.codeword_indices(words)
    for i, j in itertools.combinations(range(simhash.LENGTH), 2):
        other = simhash.codeword_indices(words ^ (1 << i | 1 << j))
        meet = ((own[:, :, None] == other[:, None, :]) & (own[:, :, None] >= 0)).any(axis=(1, 2))
        assert meet.all()


def test_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, i) for i in range(501, 540)] + [(rnd.randrange(50), rnd.randrange(50)) for _ in range(30)] + [(None, 3), (77, 77)]
    root = {}

    def find(i):
        root.setdefault(i, i)
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for i in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality_learns_and_shrinks(spark, table):
    rnd = random.Random(10)
    rows, labels = [], []
    for i in range(300):
        bad = i % 5 == 0
        words = [rnd.choice(PROSE.split()) for _ in range(60)]
        rows.append((i, " ".join(w.upper() + "!!" for w in words) if bad else " ".join(words), "en", "spam.org/x" if bad else f"site{i % 7}.org/y"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1, 0))
    labels += [(None, 1, 0), (3, None, 0), (9999, 1, 0), (4, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.classify(table(rows), labels).collect()}
    assert [got[i].keep for i in range(300)] == [i % 5 != 0 for i in range(300)]
    assert got[5].host_score < got[6].host_score
    assert {r.doc_id for r in quality.keep_good(table(rows), labels).collect()} == {i for i in range(300) if i % 5}
    assert quality.classify(table(rows), labels.limit(0)).count() == 300
    assert quality.classify(table([]), labels).count() == 0


def test_a_sparse_site_takes_the_prior():
    assert quality._spread(10, 1000, 100, 90, 0.5) == quality.NO_SPREAD
    assert quality._spread(10, 1000, 100, 90, 500) < 1


def test_odd_rows(spark, table, odd_rows):
    docs, none = table(odd_rows), table([])
    labels = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, PROSE)], "item_id long, text string")
    assert secrets.scan_secrets(docs).count() == simhash.near_duplicates(docs).count() == quality.classify(docs, labels).count() == len(odd_rows)
    assert {r.doc_id for r in decontaminate.mark_contaminated(docs, bench).where("contaminated").collect()} == {1, None}
    kept = lines.dedup_lines(docs)
    assert kept.count() == len(odd_rows) and kept.columns == [*docs.columns, "n_lines", "n_removed"]
    zero = {r.component_id for r in simhash.near_duplicates(docs).where("fingerprint = '0000000000000000'").collect()}
    assert zero == {2}
    assert simhash.keep_first_copies(docs).columns == docs.columns
    assert secrets.scan_secrets(none).count() == simhash.near_duplicates(none).count() == lines.dedup_lines(none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, rows = docs.columns, docs.count()
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == columns and kept.count() <= rows
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "n_tokens", "ids", "decoded"]
    assert len(corpus_pipeline.STAGES) == 5


def test_near_copies_equal_brute_force(spark, table):
    rnd = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randrange(60, 500))]
        texts.append(base)
        for _ in range(3):
            copy = list(base)
            for _ in range(rnd.randrange(1, max(2, len(base) // 30))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(9000, ""), (9001, None), (9002, "One  two"), (9003, "one two"), (9004, "one three")]
    sets = {i: {tuple((t or "").lower().split()[j : j + 5]) for j in range(max(1, len((t or "").split()) - 4))} for i, t in rows}
    pairs = [(i, j) for i, j in itertools.combinations(sets, 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    root = {i: i for i in sets}
    for i, j in pairs:
        low, high = sorted((root[i], root[j]))
        root = {k: low if r == high else r for k, r in root.items()}
    far = {i: plain_fingerprint(t) for i, t in rows}
    assert sum((far[i] ^ far[j]).bit_count() > 4 for i, j in pairs) > len(pairs) / 3  # beyond four bits
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(table(rows)).collect()}
    assert got == root
    kept = simhash.keep_first_copies(table(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(root.values()))
    hits = [bool(set(simhash.minima_keys(simhash.shingle_set(rows[i][1], 5))) & set(simhash.minima_keys(simhash.shingle_set(rows[j][1], 5)))) for i, j in pairs if j < 9000]
    assert np.mean(hits) > 0.99


def test_sketches_differ_in_no_more_bits_than_their_sets(spark):
    assert spark.sql("SELECT bit_count(-1L) AS n").first().n == 64
    rnd = np.random.default_rng(5)
    for n in (0, 1, 30, 400, 5000):
        a = np.unique(rnd.integers(0, 1 << 64, n, np.uint64))
        for changed in (0, 1, n // 10, n):
            b = np.union1d(a[changed:], rnd.integers(0, 1 << 64, changed // 2, np.uint64))
            bits = int(np.bitwise_count((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)).sum())  # of signed words numpy counts the bits of the size
            differ = len(np.setxor1d(a, b))
            assert bits <= differ and bits % 2 == differ % 2
            if 0 < differ <= 40:
                assert bits > differ / 2  # so that it tells sets apart


def test_near_copies_come_from_linked_fingerprints(spark, monkeypatch):
    """The pipeline's stage takes candidates from SimHash links; here from nothing else."""
    monkeypatch.setattr(simhash, "minima_keys", lambda shingles: [])
    rnd = random.Random(5)
    rows = []
    for i in range(0, 60, 2):
        words = [f"w{rnd.randrange(5000)}" for _ in range(400)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:-1], "changed"]))]
    prints = [simhash.fingerprint(t, 5) for _, t in rows]
    near = {i for i in range(0, 60, 2) if ((prints[i] ^ prints[i + 1]) & (1 << 64) - 1).bit_count() <= simhash.RADIUS}
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(near) > 20 and all(got[i + 1] == i for i in near)
    # Linked fingerprints alone are not enough: the shingles are compared.
    short = [(0, "a b c d e"), (1, "a b c d f")]
    monkeypatch.setattr(simhash, "majority_bits", lambda blocks: sum(1 for _ in blocks))
    assert {r.component_id for r in simhash.similar_documents(spark.createDataFrame(short, "doc_id long, text string")).collect()} == {0, 1}
