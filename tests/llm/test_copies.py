"""Near copies, repeated strings, near vectors: brute force on small tables, and edge cases."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from weftline.llm import collision_count, common, hyperminhash, suffix_index
from weftline.llm.common import Scratch, connected_components, table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("in_one_task", [10**6, 0])
def test_components(spark, monkeypatch, in_one_task):
    monkeypatch.setattr(common, "TASK_EDGES", in_one_task)
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2200)] + [(7, 7)]
    df = spark.createDataFrame(links, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(df, Scratch(spark, "t")).collect()}
    want = components({n for e in links for n in e}, links)
    assert all(want[n] == c for n, c in got.items())
    sizes = Counter(want.values())
    assert {n for n in want if sizes[want[n]] > 1} == set(got)
    assert connected_components(spark.createDataFrame([], "src long, dst long"), Scratch(spark, "t")).count() == 0


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(common, "CHUNK", 64)
    rng = random.Random(9)
    known = {}
    for _ in range(300):
        text = b"".join(rng.choice([b" ", b"\n", b"ab", b"c", b"x" * rng.choice([5, 63, 64, 65, 200])]) for _ in range(rng.randrange(40)))
        got = common.word_hashes(text, hyperminhash._SPACE).tolist()
        words = text.split()
        assert len(got) == len(words)
        for w, h in zip(words, got, strict=True):
            assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


def near(spark, rows):
    df = spark.createDataFrame(rows, DOCS).withColumn("rep", F.lit(1)).withColumn("bands", F.lit("clash"))
    return [r.asDict() for r in hyperminhash.near_duplicates(df, Scratch(spark, "t")).collect()]


def brute_near(rows):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(hyperminhash.shingle_set(t))
    links = [(a, b) for a in sets for b in sets if a is not None and b is not None and a < b and any(x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b])]
    return components(sets, links)


def test_near_copies_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SF, "documents").select("doc_id", "text").collect()]
    want = brute_near(rows)
    got = hyperminhash.op3_hyperminhash(spark, SF).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_group_whose_members_are_not_all_alike(spark):
    # edits grow along the group, so that the smallest member is no copy of most
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(1, 9)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = near(spark, rows)
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows)
    assert 1 < len({r["component_id"] for r in got}) < 60


@pytest.mark.parametrize("sizes", [None, (16, 256)])
def test_unlinked_near_copies_make_no_pairs(spark, monkeypatch, sizes):
    # every two share about 69 %, so registers rule few pairs out; some have a copy
    if sizes:
        monkeypatch.setattr(hyperminhash, "BLOCK", sizes[0])
        monkeypatch.setattr(hyperminhash, "BLOCK_SHINGLES", sizes[1])
    base = [f"w{i}" for i in range(90)]
    rows = [(i, " ".join([*base, *(f"own{i}-{j}" for j in range(20))])) for i in range(150)]
    rows += [(i + 1000, f"{rows[i][1]} more") for i in range(0, 150, 10)]
    scratch = Scratch(spark, "t")
    got = hyperminhash.near_duplicates(spark.createDataFrame(rows, DOCS), scratch).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute_near(rows)
    if not sizes:  # a block to a bucket
        assert spark.read.parquet(scratch.path("asked")).count() <= 2 * spark.read.parquet(scratch.path("rest-rows")).count()


def test_near_copies_whatever_is_compared_first(spark):
    docs = table(spark, SF, "documents").select(F.xxhash64("doc_id").alias("doc_id"), "text", F.col("doc_id").alias("order"))
    found = lambda first: sorted(map(tuple, hyperminhash.near_duplicates(docs, Scratch(spark, "t"), first=first).collect()))
    plain = found(None)
    for order in (F.col("order"), F.when(F.col("order") % 2 == 0, -F.col("order"))):
        assert found(docs.select("doc_id", order.alias("order"))) == plain


def test_near_edge_cases(spark):
    words = " ".join(f"word{i}" for i in range(40))
    rows = [(1, None), (2, ""), (3, " \t\n\x0b"), (4, "A b"), (5, "a  B "), (6, "a b c"), (7, words), (8, words.upper() + " more"), (None, words), (9, " x"), (10, " X"), (11, "É é"), (12, "é é"), (8, "something else"), (13, "something else"), (7, words)]
    got = near(spark, rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert len(got) == len(rows)
    assert [by[i][0]["n_shingles"] for i in (1, 2, 3, 4, 7)] == [0, 0, 0, 1, 36]
    assert [by[i][0]["component_id"] for i in (1, 2, 3, 4, 5, 6, 8, 10, 12)] == [1, 2, 3, 4, 4, 6, 7, 9, 12]
    assert by[13][0]["component_id"] == 7  # document 8 is one node with two texts
    assert by[None][0]["component_id"] is None
    assert by[None][0]["kept"] is None
    assert near(spark, []) == []


def test_registers_and_estimate():
    x = np.array([0, 1, 2**63, 2**63 + 2**62, 2**53, 2**64 - 1], dtype=np.uint64)
    zeros = hyperminhash.compress(x) >> 10
    assert zeros[2:].tolist() == [0, 0, 10, 0]
    assert hyperminhash.compress(x)[2] != hyperminhash.compress(x)[3]
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.75, 0.9):
        common = [f"c{i}" for i in range(int(2000 * share / (1 + share)))]
        guesses = []
        for k in range(20):
            sets = [common + [f"{side}{k}-{i}" for i in range(1000 - len(common))] for side in "ab"]
            regs = []
            for words in sets:
                h = np.array([hyperminhash.xxhash.xxh64_intdigest(f"{w}{k}") for w in words], dtype=np.uint64)
                regs.append(hyperminhash.compress((h[:, None] * hyperminhash.multipliers()).min(0)))
            n = np.array([1000])
            guesses.append(hyperminhash.estimate(np.array([(regs[0] == regs[1]).mean()]), n, n)[0])
        assert abs(np.mean(guesses) - share) < 0.05
    assert rng is not None


def brute_repeats(rows, length=suffix_index.LENGTH):
    count = Counter(t[i : i + length] for _, t in rows for i in range(len(t) - length + 1))
    out = []
    for i, t in rows:
        covered = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                covered[p : p + length] = b"\1" * length
        kept = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        runs = sum(c and (p == 0 or not covered[p - 1]) for p, c in enumerate(covered))
        out.append((i, len(t), len(t) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def repeats(spark, rows, **options):
    df = spark.createDataFrame(rows, DOCS).withColumn("row", F.lit("clash")).withColumn("spans", F.lit(1))
    return sorted((tuple(r)[:5] for r in suffix_index.remove_repeats(df, Scratch(spark, "t"), **options).collect()), key=str)


def passages(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (20, 45, 60, 120)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(1, 60)) for _ in range(3)]
        parts[1:1] = [p[rng.randrange(30) : len(p) - rng.randrange(30)] for p in rng.sample(shared, rng.randrange(3))]
        rows.append((i, " é ".join(parts)))
    return rows + [(100, rows[3][1]), (101, rows[3][1]), (102, "line of a text. " * 60), (103, "a" * 500), (104, "x" * 199), (105, "x" * 199), (106, "y" * 200), (107, "z" * 201)]


@pytest.mark.parametrize("batches", [1, 3, 4])
def test_repeats(spark, batches):
    rows = passages()
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    assert sum(w[2] for w in want) > 0
    assert repeats(spark, rows, batches=batches) == want


def test_repeats_by_blocks_of_windows(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT", 2)
    rows = passages(2)
    assert repeats(spark, rows) == brute_repeats([(i, t.encode()) for i, t in rows])


def test_common_grams_need_no_bucket(spark, monkeypatch):
    monkeypatch.setattr(suffix_index, "HOT_ENTRIES", 3)
    rows = passages(3)
    assert repeats(spark, rows) == brute_repeats([(i, t.encode()) for i, t in rows])


def test_repeats_edge_cases(spark):
    same = "q" * 50 + "r" * 150 + "s"
    rows = [(1, None), (2, ""), (None, same), (3, same), (4, same), (4, same), (5, "short"), (5, "short")]
    assert repeats(spark, rows) == brute_repeats([(i, (t or "").encode()) for i, t in rows])
    assert repeats(spark, []) == []


def test_contexts_are_told_apart_by_128_bits():
    data = np.random.default_rng(4).integers(97, 123, 3000, dtype=np.uint8)
    start, windows, _, _, whole, rest = suffix_index.entries(data, np.array([1200, 3000]))
    assert len(start) > 10
    for a, n, x, y in zip(start.tolist(), windows.tolist(), whole.tolist(), rest.tolist(), strict=True):
        digest = xxhash.xxh3_128_digest(data[a : a + n - 1 + suffix_index.LENGTH].tobytes())
        assert np.array([x, y], dtype=np.int64).tobytes() == digest


def test_repeats_of_a_document_that_is_there_many_times(spark):
    rng = np.random.default_rng(5)
    part = lambda n: bytes(rng.integers(97, 123, n, dtype=np.uint8)).decode()
    shared = part(230)
    often = part(300) + shared + part(100)
    rows = [(1, often)] * 150 + [(2, part(50) + shared + part(260)), (3, part(199)), (3, None), (4, shared[:205] + part(30)), (5, "short"), (5, "short")]
    assert repeats(spark, rows) == brute_repeats([(i, (t or "").encode()) for i, t in rows])


def test_repeats_in_text_with_short_periods(spark):
    rng = random.Random(4)
    noise = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    rows = []
    for i in range(120):
        period = noise(rng.choice([1, 2, 3, 7, 30, 64, 100, 136, 137, 150]))
        rows.append((i, noise(rng.randrange(90)) + (period * 800)[: rng.randrange(190, 800)] + noise(rng.randrange(90))))
    want = brute_repeats([(i, t.encode()) for i, t in rows])
    assert 5 < sum(w[2] == 0 for w in want) < 100
    assert repeats(spark, rows) == want


def test_repetitive_texts_have_few_entries():
    for period in (b"a", b" ", b"line\n", b"a longer line of some text that is repeated again and again\n"):
        data = np.frombuffer((period * (1 << 20))[: suffix_index.CHUNK], np.uint8)
        start, windows, *_ = suffix_index.entries(data, np.array([len(data)]))
        assert len(start) < len(data) / 60
        assert windows[windows > 0].sum() == len(data) - suffix_index.LENGTH + 1


@pytest.mark.parametrize("unit", [" ", "e", "a line that is there again and again, whatever comes of it\n"])
def test_repeats_in_a_long_repetitive_text(spark, unit):
    n = 8 << 20
    text = (unit * (n // len(unit) + 1))[:n]
    got = repeats(spark, [(1, "once " + text + " and out"), (2, "other text")])
    assert [g[2] > n - 2 and g[3] == 1 if g[0] == 1 else g[2] == 0 for g in got] == [True, True]


def test_rows_whose_hashes_agree_are_told_apart(spark):
    texts = [(i, f"text {i} " * 40) for i in range(6)] + [(2, "text 2 " * 40)]
    docs = spark.createDataFrame(texts, DOCS)
    got = suffix_index.with_rows(docs, F.pmod("doc_id", F.lit(3))).collect()
    assert len({r["row"] for r in got}) == 6
    assert len({r["row"] for r in got if r["doc_id"] == 2}) == 1


def test_spans_are_merged_before_they_are_gathered(spark):
    spans = [(1, i, i + 200) for i in range(0, 150_000, 7)] + [(2, 5, 300), (2, 5, 205), (2, 301, 501), (2, 300, 501)]
    got = {(r["row"], r["start"], r["stop"]) for r in suffix_index.merged_by_tile(spark.createDataFrame(spans, suffix_index.SPAN)).collect()}
    assert len(got) == 4
    assert (2, 5, 501) in got


def test_repeats_in_very_long_texts(spark):
    rng = np.random.default_rng(3)
    long = bytes(rng.integers(97, 123, suffix_index.CHUNK * 2 + 12345, dtype=np.uint8)).decode()
    cut = suffix_index.CHUNK - 150  # across the end of a block
    rows = [(1, long), (2, "start " + long[cut : cut + 400] + " end"), (3, long[5:205])]
    got = {r[0]: r for r in repeats(spark, rows)}
    assert got[2][2:4] == (400, 1)
    assert got[3][2] == 200
    assert got[1][2:4] == (600, 2)


def test_levels_merge_as_a_counter(spark):
    scratch = Scratch(spark, "t")
    index = suffix_index.SuffixIndex(scratch)
    rows = spark.createDataFrame(passages(), DOCS).selectExpr("doc_id AS row", "text")
    sizes = []
    for i in range(5):
        index.add(suffix_index.suffixes(rows.where(F.col("row") % 5 == i)))
        sizes.append(sorted(index.levels))
    assert sizes == [[0], [1], [0, 1], [2], [0, 2]]
    index.close()


def brute_vectors(rows):
    good = {}
    for k, (i, x) in enumerate(rows):
        if i is not None and x and all(v is not None and np.isfinite(v) for v in x) and any(x):
            v = np.array(x, dtype=np.float64)
            v = v / np.abs(v).max()
            good[k] = v / np.linalg.norm(v)
    links = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    root = components(range(len(rows)), links)
    n = Counter(x for e in links for x in e)
    low = {}
    for k, (i, _) in enumerate(rows):
        if k in good:
            low[root[k]] = min(low.get(root[k], i), i)
    return sorted(((i, n[k], low[root[k]] if k in good else i) for k, (i, _) in enumerate(rows)), key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    return sorted((tuple(r)[:3] for r in collision_count.near_vectors(df, Scratch(spark, "t")).collect()), key=str)


def test_near_vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((80, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    # cosines on both sides of the threshold
    for k in range(400):
        x, noise = base[k % 20], rng.standard_normal(32)
        noise -= noise @ x / (x @ x) * x
        angle = np.arccos(rng.uniform(0.8, 0.999))
        rows.append((1000 + k, (np.cos(angle) * x / np.linalg.norm(x) + np.sin(angle) * noise / np.linalg.norm(noise)).tolist()))
    rows += [(3000 + k, base[1].tolist()) for k in range(30)] + [(4000, (base[2] * 5).tolist())]
    want = brute_vectors(rows)
    got = vectors(spark, rows)
    assert got == want


def test_near_vectors_in_bands(spark, monkeypatch):
    monkeypatch.setattr(collision_count, "BAND", 60)
    rng = np.random.default_rng(6)
    centres = rng.standard_normal((10, 16)) * np.array([6.0] + [1.0] * 15)
    rows = [(i, (centres[i % 10] + 0.3 * rng.standard_normal(16)).tolist()) for i in range(500)]
    assert vectors(spark, rows) == brute_vectors(rows)


def test_vector_edge_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, nan]), (6, [inf, 1.0]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1e-300, 0.0]), (10, [1e300, 1e299]), (11, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (7, [1.0, 0.0]), (12, [5.0]), (13, [0.1])]
    assert vectors(spark, rows) == brute_vectors(rows)
    assert vectors(spark, []) == []


def test_recall_of_the_least_count():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.9 * x + (1 - 0.81) ** 0.5 * noise
    m, half = collision_count.PROJECTIONS, collision_count.window(64)
    hits = (np.abs((x - y) @ collision_count.rotation(64)[:, :m]) <= half).sum(1)
    assert (hits >= collision_count.least_count(m)).mean() > 0.9999


def test_collisions_are_those_of_windows():
    rng = np.random.default_rng(2)
    for n, k in ((130, 70), (64, 1), (1, 5)):
        rows, queries = rng.standard_normal((n, 9)).round(1), rng.standard_normal((k, 9)).round(1)
        count = (np.abs(rows[None] - queries[:, None]) <= 0.55).sum(2)
        for need in (0, 1, 4, 9):
            got = set(zip(*(x.tolist() for x in collision_count.collisions(queries, *collision_count.prefixes(rows), 0.55, need)), strict=True))
            assert got == {(i, j) for i in range(k) for j in range(n) if count[i, j] >= need}


def test_parts_meet_where_a_chord_may_join_them(spark):
    rng = random.Random(3)
    parts = [(s, b, p, low, low + rng.uniform(0, 0.5)) for s in (2, 3) for b in range(9) for low in [rng.uniform(-1, 0.5)] for p in range(rng.randrange(1, 3))]
    got = {(r["size"], tuple(r["one"]), tuple(r["other"])) for r in collision_count.meeting(spark.createDataFrame(parts, "size int, band int, part int, least double, most double"), 0.2).collect()}
    want = {(s, (b, p), (c, q)) for s, b, p, low, high in parts for t, c, q, lo, hi in parts if s == t and (b, p) <= (c, q) and lo - high <= 0.2 and low - hi <= 0.2}
    assert got == want


def test_recall_of_links_among_many_vectors():
    """All links of 50 000 vectors in groups, against all cosines in blocks."""
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((9000, 64))
    x = centres[rng.integers(0, 9000, 50_000)] + rng.uniform(0.05, 0.5, (50_000, 1)) * rng.standard_normal((50_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = 0
    for a in range(0, len(x), 2000):
        want += int((x[a : a + 2000] @ x.T >= 0.9).sum()) - 2000
    weight = np.ones(len(x), dtype=np.int64)
    got = 0
    bands = [slice(a, a + 12_500) for a in range(0, len(x), 12_500)]
    for i, one in enumerate(bands):
        for other in bands[i:]:
            links, _ = collision_count.compare(x[one], None if one == other else x[other], weight[one], None if one == other else weight[other])
            got += int(links[0].sum()) + (0 if one == other else int(links[1].sum()))
    assert want > 20_000
    assert got <= want
    assert got >= 0.999 * want
