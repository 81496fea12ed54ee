"""Sharding, conversation tries and Merkle manifests against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weftline.llm import merkle, minimax_shards, prefix_trie, scans
from weftline.llm.common import Scratch

DOCS = "doc_id long, text string, lang string, source string, n_chars long, shard int, digest string"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def documents(spark, rows, tmp_path):
    spark.createDataFrame([(i, t, la, s, n, 9, "x") for i, t, la, s, n in rows], DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    return str(tmp_path)


# sharding


def least_capacity(sizes, k):
    def fits(c):
        shards, filled = 1, 0
        for s in sizes:
            if s > c:
                return False
            if filled + s > c:
                shards, filled = shards + 1, 0
            filled += s
        return shards <= k

    return next(c for c in range(sum(sizes) + 1) if fits(c))


def check_shards(got, rows, n):
    """Laws of a result; sizes of shards by number."""
    by_doc = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got)
    assert by_doc == sorted((i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    slots, weights = defaultdict(list), defaultdict(int)
    for r in got:
        assert 0 <= r["shard"] < n
        slots[r["shard"]].append(r["slot"])
        weights[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = defaultdict(set)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        if r["doc_id"] is not None:
            where[texts[r["doc_id"]]].add(r["shard"])
    assert all(len(v) == 1 for v in where.values())
    return weights


@pytest.mark.parametrize(("seed", "points", "n"), [(1, 4, 5), (2, 16, 3), (3, 8192, 7), (4, 3, 24)])
def test_shards_are_minimax(spark, monkeypatch, seed, points, n):
    monkeypatch.setattr(minimax_shards, "POINTS", points)
    random.seed(seed)
    rows = [(i, "ü" * random.choice([0, 1, 5, 30, 90]) + str(random.randrange(60))) for i in range(150)]
    rows += [(None, None), (None, ""), (1000, None), (1000, None)]
    got = rows_of(minimax_shards.shards(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), n))
    weights = check_shards(got, rows, n)
    groups = defaultdict(int)
    for _, t in rows:
        groups[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    left, large = sum(groups.values()), []
    for g in sorted(groups, key=lambda g: (-groups[g], g))[: n - 1]:
        if groups[g] * (n - len(large)) <= left:
            break
        large.append(g)
        left -= groups[g]
    want = least_capacity([groups[g] for g in sorted(groups) if g not in large], n - len(large))
    assert {r["capacity"] for r in got} == {want}
    assert [weights[i] for i in range(len(large))] == [groups[g] for g in large]
    assert max(w for s, w in weights.items() if s >= len(large)) == want


def test_a_text_of_a_third_of_all_rows_leaves_the_others_even(spark):
    rows = [(i, "the same" * 100 if i % 3 == 0 else f"{i} " + "x" * (i % 50)) for i in range(600)]
    got = rows_of(minimax_shards.shards(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark, "t"), 8))
    weights = check_shards(got, rows, 8)
    assert weights[0] == 200 * 808
    rest = [weights[s] for s in range(1, 8)]
    assert max(rest) - min(rest) < 160


def test_shards_of_few_and_no_rows(spark, tmp_path):
    path = documents(spark, [], tmp_path / "none")
    assert rows_of(minimax_shards.op11_minimax_shards(spark, path)) == []
    path = documents(spark, [(1, None, None, None, None), (2, "a", "en", "s", 1)], tmp_path / "two")
    got = rows_of(minimax_shards.op11_minimax_shards(spark, path))
    assert sorted((r["doc_id"], r["size"], r["law"], r["slot"], r["grown_shard"]) for r in got) == [(1, 8, "bytes", 0, None), (2, 9, "bytes", 0, None)]
    assert len({r["shard"] for r in got}) == 2


def test_sharding_runs_no_python(spark):
    df = minimax_shards.op11_minimax_shards(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# tries


def trie_by_force(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in own.items()}
    built = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + mine[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    out = []
    for node, convs in members.items():
        below = [m for m in members if m[: len(node)] == node]
        children = [m for m in below if len(m) == len(node) + 1]
        leaves = [m for m in below if not any(o[: len(m)] == m and len(o) > len(m) for o in below)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children), len(leaves), saved, digest))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string, n_convs int, depth string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_of(spark, rows, tmp_path):
    spark.createDataFrame([(*r, 1, "z") for r in rows], TURNS).repartition(3).write.parquet(f"file://{tmp_path}/conversations.parquet")
    df = prefix_trie.op12_sequence_collapse(spark, str(tmp_path))
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(scans, "BLOCK", 2)
    monkeypatch.setattr(prefix_trie, "PIECE_BITS", 1)
    random.seed(seed)
    rows = []
    for c in random.sample(range(60), 45):
        for turn in range(random.choice([0, 1, 2, 3, 5, 12])):
            rows.append((c, turn, random.choice(["user", "assistant", None]), random.choice(["a", "ü", "", None])))
    rows += [(3, None, "user", "first"), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (None, 1, "user", "nobody"), (7, 2, "x" * 20, "y"), (7, 2, "x" * 17, "z")]
    assert trie_of(spark, rows, tmp_path) == trie_by_force(rows)


def test_trie_of_equal_and_long_conversations(spark, tmp_path):
    rows = [(c, t, "user", f"{t}") for c in range(100, 400) for t in range(2)]
    rows += [(5, t, "user", "again") for t in range(3000)]
    got = trie_of(spark, rows, tmp_path)
    assert len([g for g in got if g[1] == 3000]) == 1
    short = [r for r in rows if r[0] != 5]
    want = trie_by_force(short)
    assert [g for g in got if g[1] == 2 and g[0] >= 100] == [w for w in want if w[1] == 2]


def test_trie_of_nothing(spark, tmp_path):
    assert trie_of(spark, [], tmp_path / "a") == []
    assert trie_of(spark, [(None, 1, "user", "x")], tmp_path / "b") == []
    one = trie_of(spark, [(1, 1, "user", "x")], tmp_path / "c")
    assert one == trie_by_force([(1, 1, "user", "x")])


# manifests


def hashed(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(digests):
    """Root, and for each leaf its steps upwards: (sibling or None, whether the leaf's side is right)."""
    paths = [[] for _ in digests]
    level, under = list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        above, groups = [], []
        for i in range(0, len(level), 2):
            pair = level[i : i + 2]
            for j in range(len(pair)):
                for leaf in under[i + j]:
                    paths[leaf].append((pair[1 - j] if len(pair) > 1 else None, j == 1))
            above.append(hashed(*pair))
            groups.append([x for u in under[i : i + 2] for x in u])
        level, under = above, groups
    return level[0], paths


def proofs_by_force(rows):
    langs = defaultdict(list)
    for i, text, lang, source, n in rows:
        digest = lambda k: hashed(*(field(v) for v in (i, source, lang, k, text)))  # noqa: B023, E731
        other = digest(None if n is None else n + 1) if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else None
        langs[lang].append((i is not None, i or 0, digest(n), other, i))
    order = sorted(langs, key=lambda la: (la is not None, (la or "").encode()))
    trees = {la: tree([x[2] for x in sorted(langs[la], key=lambda x: x[:3])]) for la in order}
    root, high = tree([trees[la][0] for la in order])
    out = []
    for k, la in enumerate(order):
        for x, path in zip(sorted(langs[la], key=lambda x: x[:3]), trees[la][1], strict=True):
            steps = path + high[k]
            at = x[3] or x[2]
            for sibling, right in steps:
                at = hashed(at) if sibling is None else hashed(sibling, at) if right else hashed(at, sibling)
            out.append((x[4], x[2], trees[la][0], root, hashed(*(s for s, _ in steps if s)), at, at == root))
    return sorted(out, key=repr)


def many_documents():
    random.seed(5)
    rows = [(i, f"text ü {i}" * (i % 4), random.choice(["en", "de", "é", "z", None]), random.choice(["web", None]), random.choice([i, None, -1, 2**63 - 1])) for i in range(90)]
    return rows + [(7, "twice", "en", "s", 1)] * 9 + [(None, "a", "en", "s", 1), (None, None, None, None, None), (200, "alone", "xx", "s", 3)]


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_proofs_equal_brute_force(spark, tmp_path, monkeypatch, bits):
    monkeypatch.setattr(merkle, "BITS", bits)
    rows = many_documents()
    path = documents(spark, rows, tmp_path)
    monkeypatch.setattr(merkle.build, "__defaults__", (bits,))
    df = merkle.op13_merkle_descent(spark, path)
    assert sorted((tuple(r) for r in df.collect()), key=repr) == proofs_by_force(rows)


def test_manifests_of_one_and_no_rows(spark, tmp_path):
    df = merkle.op13_merkle_descent(spark, documents(spark, [], tmp_path / "none"))
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert df.collect() == []
    rows = [(1, None, None, None, None)]
    got = merkle.op13_merkle_descent(spark, documents(spark, rows, tmp_path / "one")).collect()
    assert [tuple(r) for r in got] == proofs_by_force(rows)
    assert got[0]["leaf"] == got[0]["root"] and got[0]["verified"]
