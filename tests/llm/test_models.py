"""Language, quality, decontamination, packing and the pipeline."""

import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from weftline.llm import decontaminate, hyperminhash, language_mix, neighbour_vote, packing, suffix_index
from weftline.llm.common import Scratch, table

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string"


def held(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_accuracy(spark):
    got = language_mix.op6_language_mixture(spark, SF).collect()
    lang = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    tested = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in tested} == {i for i in lang if held(i, 5) == 0}
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in tested]) > 0.99
    assert all(0 <= r["score"] <= 1 for r in got)


def test_mixtures_are_told(spark):
    docs = table(spark, SF, "documents")
    model = language_mix.fit(docs)
    text = {r["lang"]: r["text"] for r in docs.where("n_chars between 1000 and 2000").select("lang", "text").collect()}
    langs = model[0]
    for a, b in (("en", "de"), ("fr", "es")):
        half = text[a][:900] + " " + text[b][:450]
        chosen, share, _ = language_mix.select(model[1], half)
        assert {langs[i] for i in chosen} == {a, b}
        assert langs[chosen[int(np.argmax(share))]] == a
        assert abs(share.max() - 2 / 3) < 0.12


def test_language_edge_cases(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    model = language_mix.fit(docs)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 ,; ² ½"), (4, "a"), (None, "the of and"), (5, "the and of " * 100_000), (5, "x")], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = language_mix.identify(odd, model).collect()
    assert len(got) == 7
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert by[4]["lang_pred"] in model[0]
    assert by[None]["lang_pred"] == "en"
    empty = language_mix.fit(docs.limit(0))
    assert language_mix.identify(odd, empty).where("lang_pred <> 'und'").count() == 0
    assert language_mix.identify(odd.limit(0), model).count() == 0
    assert language_mix.fit(docs.withColumn("lang", F.lit(None).cast("string")))[0] == []


def test_proportions_are_those_of_a_plain_loop():
    rng = np.random.default_rng(7)
    for langs in (1, 2, 4):
        prob, counts = rng.uniform(0.01, 1, (30, langs)), rng.integers(1, 9, 30)
        w = [1 / langs] * langs
        for _ in range(language_mix.STEPS if langs > 1 else 0):
            got = [0.0] * langs
            for p, n in zip(prob.tolist(), counts.tolist(), strict=True):
                total = sum(a * b for a, b in zip(p, w, strict=True))
                for i in range(langs):
                    got[i] += n * w[i] * p[i] / total
            w = [g / int(counts.sum()) for g in got]
        found, likelihood = language_mix.proportions(prob, counts)
        assert found == pytest.approx(w)
        assert likelihood == pytest.approx(float(counts @ np.log(prob @ np.array(w))))


def test_equal_languages_go_to_the_first_by_name(spark):
    rng = np.random.default_rng(8)
    one = np.log(rng.dirichlet(np.ones(language_mix.SLOTS))).astype(np.float32)
    model = (["aa", "bb"], np.stack([one, one], 1))
    docs = spark.createDataFrame([(1, "some words"), (1, "some words"), (2, "other words")], "doc_id long, text string").withColumn("lang_pred", F.lit("clash")).withColumn("score", F.lit("clash"))
    got = language_mix.identify(docs, model).collect()
    assert {r["lang_pred"] for r in got} == {"aa"}
    assert len({(r["score"], tuple(r["languages"])) for r in got if r["doc_id"] == 1}) == 1


@pytest.mark.parametrize("doc_id", [1, 2, 3, 4, 6, 7, 8, 9, None])
def test_language_of_rows_that_share_a_doc_id_is_learned(spark, doc_id):
    if held("" if doc_id is None else doc_id, 5) == 0:
        return
    common = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the of and in to").alias("text"), F.lit("en").alias("lang"))
    same = spark.range(2500).select(F.lit(doc_id).cast("long").alias("doc_id"), F.concat(F.lit("zzz qqq "), F.col("id").cast("string")).alias("text"), F.lit("xx").alias("lang"))
    assert language_mix.fit(common.unionByName(same), 50)[0] == ["en", "xx"]


def test_language_of_one_repeated_row_counts_it_once(spark):
    rows = [(1, "zzz qqq", "xx")] * 500 + [(2, "yyy", "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    once = spark.createDataFrame(list(dict.fromkeys(rows)), docs.schema)
    assert np.array_equal(language_mix.fit(docs)[1], language_mix.fit(once)[1])


def test_language_query_against_a_plain_loop(spark, tmp_path):
    """Counts, EM, sets and scores in dictionaries and loops."""
    rng = np.random.default_rng(12)
    vocabulary = {la: [f"{la}{w:x}" for w in rng.integers(0, 4096, 60)] for la in ("de", "en", "fr")}
    rows = []
    for i in range(90):
        la = ("de", "en", "fr")[i % 3]
        other = ("de", "en", "fr")[(i + 1) % 3]
        text = " ".join(rng.choice(vocabulary[la], 30)) + " " + " ".join(rng.choice(vocabulary[other], 20 if i % 4 == 0 else 0))
        rows.append((i, text, la if i % 10 else None))
    rows += [(7, "zz zz", "en"), (None, None, "en"), (300, "12", "fr"), (301, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")

    def grams(text):
        b = f" {text.lower()} ".encode()
        return [((b[i] << 16 | b[i + 1] << 8 | b[i + 2]) * 2654435761 % 2**32) >> 16 for i in range(len(b) - 2)]

    letters = lambda t: bool(t) and any(c.isalpha() for c in t)
    first = {}
    for i, text, la in rows:  # no other doc_id repeats; its two texts differ in hash, so both are tried below
        if la is not None and held("" if i is None else i, 5):
            first.setdefault((la, i), []).append(text)
    options = [{}]
    for key, texts in first.items():
        options = [o | {key: t} for o in options for t in texts]
    results = []
    for option in options:
        counts = {}
        for (la, _), text in option.items():
            if letters(text):
                for g in grams(text):
                    counts.setdefault(la, Counter())[g] += 1
        langs = sorted(counts)
        log = {la: {} for la in langs}
        total = {la: sum(counts[la].values()) + 0.5 * language_mix.SLOTS for la in langs}
        out = []
        for i, text, _ in rows:
            if not letters(text):
                out.append((i, "und", 0.0, ()))
                continue
            bag = Counter(grams(text))
            prob = {g: {la: float(np.float32(np.log((counts[la][g] + 0.5) / total[la]))) for la in langs} for g in bag}
            top = {g: max(p.values()) for g, p in prob.items()}
            prob = {g: {la: np.exp(p[la] - top[g]) for la in langs} for g, p in prob.items()}
            n = sum(bag.values())

            def em(some):
                w = {la: 1 / len(some) for la in some}
                for _ in range(language_mix.STEPS if len(some) > 1 else 0):
                    new = dict.fromkeys(some, 0.0)
                    for g, c in bag.items():
                        mixed = sum(w[la] * prob[g][la] for la in some)
                        for la in some:
                            new[la] += c * w[la] * prob[g][la] / mixed
                    w = {la: v / n for la, v in new.items()}
                return w, sum(c * np.log(sum(w[la] * prob[g][la] for la in some)) for g, c in bag.items())

            full, _ = em(langs)
            order = sorted(langs, key=lambda la: -full[la])
            best = None
            for size in range(1, max(1, sum(v >= language_mix.LEAST_SHARE for v in full.values())) + 1):
                w, likelihood = em(order[:size])
                value = likelihood / 3 - 0.5 * size * np.log(max(n, 2))
                if best is None or value > best[0]:
                    best = (value, w)
            name = min(best[1], key=lambda la: (-best[1][la], la))
            out.append((i, name, min(1.0, full[name]), tuple(sorted(best[1]))))
        results.append(out)
    got = language_mix.op6_language_mixture(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    assert any(len(r["languages"]) > 1 for r in got)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[3])
    mine = sorted(((r["doc_id"], r["lang_pred"], r["score"], tuple(sorted(r["languages"]))) for r in got), key=key)
    assert any(
        [(a[0], a[1], a[3]) for a in mine] == [(b[0], b[1], b[3]) for b in sorted(want, key=key)] and [a[2] for a in mine] == pytest.approx([b[2] for b in sorted(want, key=key)], abs=1e-6)
        for want in results
    )


def test_language_sample_ignores_held_out_rows(spark):
    rows = [(i, "le la les des" if held(i, 5) else "zzz qqq", "fr" if held(i, 5) else "xx") for i in range(50)]
    assert language_mix.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))[0] == ["fr"]


def test_quality_accuracy(spark):
    got = neighbour_vote.op4_neighbour_vote(spark, SF).collect()
    label = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in label]
    assert all(held(r["doc_id"], 3) == 1 for r in tested)
    assert np.mean([r["predicted"] == label[r["doc_id"]] for r in tested]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_quality_edge_cases(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = table(spark, SF, "labels").select("doc_id", F.col("quality").alias("label"))
    extra = spark.createDataFrame([(None, 1), (3, None)], "doc_id long, label int")
    model = neighbour_vote.fit(docs, labels.union(extra).union(labels))
    assert len(model[3]) == neighbour_vote.fit(docs, labels)[3].size
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (None, "text"), (4, "x" * 1_000_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r["doc_id"]: r["score"] for r in neighbour_vote.score(odd, model).collect()}
    assert got[1] == got[2] == pytest.approx(model[3].mean())
    none = neighbour_vote.fit(docs, labels.limit(0))
    assert {r["score"] for r in neighbour_vote.score(odd, none).collect()} == {0.5}
    assert neighbour_vote.score(odd.limit(0), model).count() == 0


def test_quality_of_a_very_long_labelled_text(spark):
    """A term that occurs more than 65,535 times counts as often as it does, learned or scored."""
    rng = np.random.default_rng(3)
    long = "".join(rng.choice(list("ab"), 400_000, p=[0.95, 0.05]))
    docs = spark.createDataFrame([(0, long), (1, "quite another text here"), (3, "and a third one of them")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in (0, 1, 3)], "doc_id long, label int").where("doc_id is not null")
    model = neighbour_vote.fit(docs, labels)
    x = neighbour_vote.weigh(neighbour_vote.counts_of(long)[None], model[0])
    z = x.astype(np.float64) @ model[1]
    known = [i for i in (0, 1, 3) if held(i, 3) != 1]
    assert 0 in known
    assert float((z / np.linalg.norm(z) @ model[2].T).max()) == pytest.approx(1, abs=1e-6)


def test_quality_frequencies_cover_all_documents(spark):
    """Labelled rows, held-out ones, unlabelled ones and empty ones count alike."""
    texts = [(i, f"plain words {i}") for i in range(12)] + [(i, f"zebra quartz {i}") for i in range(12, 60)] + [(60, None), (61, "")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, label int")
    idf = neighbour_vote.fit(docs, labels)[0]
    n = sum((neighbour_vote.counts_of(t) > 0).astype(int) for _, t in texts)
    assert idf == pytest.approx(np.log((1 + len(texts)) / (1 + n)) + 0.1)


def test_quality_against_brute_force(spark):
    """The whole query with dense products and an exact SVD."""
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    counts = np.stack([neighbour_vote.counts_of(r["text"]) for r in docs])
    idf = np.log((1 + len(docs)) / (1 + (counts > 0).sum(0))) + 0.1
    x = np.log1p(counts) * idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    learn = np.array([r["doc_id"] in labels and held(r["doc_id"], 3) != 1 for r in docs])
    v = np.linalg.svd(x[learn], full_matrices=False)[2][: neighbour_vote.RANK].T
    z = x @ v
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    label = np.array([labels[r["doc_id"]] for r, on in zip(docs, learn, strict=True) if on], dtype=float)
    cos = z @ z[learn].T
    want = {}
    for i, r in enumerate(docs):
        near = np.argsort(-cos[i])[: neighbour_vote.NEIGHBOURS]
        w = np.maximum(cos[i, near], 0) ** neighbour_vote.SHARPNESS
        want[r["doc_id"]] = (w * label[near]).sum() / w.sum()
    got = {r["doc_id"]: r["score"] for r in neighbour_vote.op4_neighbour_vote(spark, SF).collect()}
    gap = np.array([abs(got[i] - want[i]) for i in want])
    assert set(got) == set(want)
    assert gap.mean() < 0.01
    assert np.mean([(got[i] >= 0.5) == (want[i] >= 0.5) for i in want]) > 0.995


def test_recurrences_are_those_of_words():
    got = neighbour_vote.recurrences(b"a b a a  c\nb a")
    last = neighbour_vote.CLASSES - 1
    kinds = [last, last, 1, 0, last, 2, 1]  # new, new, 2 back, 1 back, new, 4 back, 3 back
    pairs = Counter(zip(kinds, kinds[1:], strict=False))
    assert got[: neighbour_vote.CLASSES].tolist() == [kinds.count(k) for k in range(neighbour_vote.CLASSES)]
    assert all(got[neighbour_vote.CLASSES + a * neighbour_vote.CLASSES + b] == n for (a, b), n in pairs.items())
    assert not neighbour_vote.recurrences(b" ").any()


def test_equally_near_documents_count_in_order():
    known = np.repeat(np.eye(3), 40, axis=0)
    label = np.r_[np.ones(25), np.zeros(95)]
    x = np.eye(3)[[0, 0, 1]]
    assert neighbour_vote.votes(x, (None, None, known, label)).tolist() == [1.0, 1.0, 0.0]


def test_repeated_rows_are_scored_alike(spark):
    docs, labels = table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels").selectExpr("doc_id", "quality AS label")
    twice = docs.union(docs.orderBy("text").limit(300)).union(docs.limit(57))
    scores = defaultdict(set)
    for r in neighbour_vote.score(twice, neighbour_vote.fit(docs, labels)).collect():
        scores[r["doc_id"]].add(r["score"])
    assert all(len(s) == 1 for s in scores.values())


def test_votes_are_exact():
    rng = np.random.default_rng(0)
    known = rng.standard_normal((200, 8))
    known /= np.linalg.norm(known, axis=1, keepdims=True)
    label = (known[:, 0] > 0).astype(float)
    x = known[:5] + 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = neighbour_vote.votes(x, (None, None, known, label))
    for i in range(5):
        cos = known @ x[i]
        near = np.argsort(-cos)[: neighbour_vote.NEIGHBOURS]
        weight = np.maximum(cos[near], 0) ** neighbour_vote.SHARPNESS
        assert got[i] == pytest.approx((weight * label[near]).sum() / weight.sum())


def leaks(spark, docs, items, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("answer", F.lit("clash"))
    b = spark.createDataFrame(items, "item_id long, text string, answer string") if len(items[0]) == 3 else spark.createDataFrame(items, "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(d, b, **options).collect() if r["doc_id"] is not None)


def words(rng, n):
    return ["".join(rng.choice(list("aeioubcdfglmnprst"), rng.integers(2, 8))) for _ in range(n)]


def test_leaks_of_the_table(spark):
    join = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    items = [(r["item_id"], join(r["text"])) for r in table(spark, SF, "benchmark").collect()]
    want = {(r["doc_id"], i) for r in table(spark, SF, "documents").collect() for i, t in items if t in join(r["text"])}
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.op9_latent_decontamination(spark, SF).collect()}
    assert want
    assert want <= got
    assert len(got - want) <= 1


def test_paraphrases_and_recall(spark):
    """Items with some words replaced or dropped, against the check on words alone over all pairs."""
    rng = np.random.default_rng(1)
    items = [(i, " ".join(words(rng, int(rng.integers(15, 90))))) for i in range(60)]
    docs = []
    for k in range(300):
        filler = words(rng, 200)
        if k % 3 == 0:
            inside = items[k % 60][1].split()
            for _ in range(int(len(inside) * rng.uniform(0, 0.45))):
                p = int(rng.integers(len(inside)))
                inside[p : p + 1] = words(rng, int(rng.integers(0, 2)))
            filler[100:100] = inside
        docs.append((k, " ".join(filler)))
    got = leaks(spark, docs, items)
    want = set()
    for d, t in docs:
        text = decontaminate.words_of(t)
        for i, item in items:
            w = decontaminate.words_of(item)
            share, told = decontaminate.lcs(w, text) / len(w), decontaminate.lcs(w[-5:], text) / 5
            if share >= decontaminate.ALONE or (share >= decontaminate.WITH_ANSWER and told >= decontaminate.ANSWER_SHARE):
                want.add((d, i))
    assert len(want) > 60
    assert len(want & set(got)) >= 0.9 * len(want)
    assert set(got) <= want
    # a basis too small for all passages still finds most
    assert len(want & set(leaks(spark, docs, items, rank=24))) >= 0.9 * len(want)


def test_paraphrases_in_the_tables_own_words(spark, monkeypatch):
    """Benchmark items that share natural words, changed by other benchmark words, within real documents; in one block of items and in many."""
    rng = np.random.default_rng(3)
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    pool = np.array([w.decode() for _, t in items for w in decontaminate.words_of(t)])
    docs = []
    for k, r in enumerate(table(spark, SF, "documents").where("length(text) between 300 and 4000").orderBy("doc_id").limit(150).collect()):
        filler = r["text"].split()
        inside = items[k % len(items)][1].split()
        for _ in range(int(len(inside) * rng.uniform(0, 0.4))):
            p = int(rng.integers(len(inside)))
            inside[p : p + 1] = rng.choice(pool, int(rng.integers(0, 2))).tolist()
        filler[len(filler) // 2 : len(filler) // 2] = inside
        docs.append((k, " ".join(filler)))
    want = set()
    words_of = {i: decontaminate.words_of(t) for i, t in items}
    for d, t in docs:
        text = decontaminate.words_of(t)
        there = set(text)
        for i, w in words_of.items():
            if len(w) < decontaminate.LEAST_WORDS or sum(x in there for x in w) < decontaminate.WITH_ANSWER * len(w):
                continue
            share, told = decontaminate.lcs(w, text) / len(w), decontaminate.lcs(w[-5:], text) / 5
            # over whole texts; a text that has the words far apart is no paraphrase, but counts here
            if share >= decontaminate.ALONE or (share >= decontaminate.WITH_ANSWER and told >= decontaminate.ANSWER_SHARE):
                want.add((d, i))
    got = leaks(spark, docs, items)
    assert len(want) > 40
    assert len(want & set(got)) >= 0.9 * len(want)
    assert set(got) <= want
    monkeypatch.setattr(decontaminate, "BLOCK", len(items) // 3)
    assert leaks(spark, docs, items) == got


def test_products_in_slices_find_the_same(monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(words(rng, 40)), None) for i in range(20)]
    idf = np.ones(decontaminate.SLOTS)
    used = np.unique(np.concatenate([decontaminate.slots_of(decontaminate.hashes_of(decontaminate.plain(t))) for _, t, _ in rows]))
    row = np.full(decontaminate.SLOTS, -1, dtype=np.int64)
    row[used] = np.arange(len(used))
    index = decontaminate._Index(rows, idf, row, np.linalg.qr(rng.standard_normal((len(used), 64)))[0].astype(np.float32))
    text = " ".join(t for _, t, _ in rows[:15])
    want = list(index.search(text))
    assert len(want) >= 15
    monkeypatch.setattr(decontaminate, "PRODUCT", 50)
    assert [pytest.approx(x, rel=1e-5) for x in want] == list(index.search(text))


def test_leak_edge_cases(spark):
    rng = np.random.default_rng(2)
    item = " ".join(words(rng, 30))
    docs = [(1, None), (2, ""), (3, item.upper() + "!!"), (None, item), (4, " ".join(words(rng, 9000)) + " " + item), (5, "the"), (3, item)]
    got = leaks(spark, docs, [(1, item), (2, None), (None, item), (3, "too short")])
    assert got == [(3, 1), (3, 1), (4, 1)]
    odd = spark.createDataFrame([(None, item)], "doc_id long, text string")
    assert decontaminate.contaminated(odd, spark.createDataFrame([(1, item)], "item_id long, text string")).first()["doc_id"] is None
    assert decontaminate.contaminated(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(spark.createDataFrame([(1, item)], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_short_items_and_short_texts(spark):
    items = [(1, "Who wrote Hamlet? William Shakespeare did"), (2, "yes"), (3, "one two three four five six seven eight"), (4, "far away"), (5, "a b c"), (6, "!?")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"word{i}" for i in range(300))
    rows = [(1, f"{filler} who wrote hamlet; william shakespeare did {filler}"), (2, "who wrote hamlet william shakespeare does"), (3, "Yes!"), (4, "yes no"), (5, "one two three four five six seven"), (6, "so far away now"), (7, "far, away"), (8, "x a b c"), (9, "a b d c"), (10, None), (11, "!")]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert sorted((r["doc_id"], r["item_id"]) for r in got.collect()) == [(1, 1), (3, 2), (5, 3), (7, 4), (8, 5)]


def test_many_bytes_of_items_are_sent_in_blocks(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(30))) for i in range(40)], "item_id long, text string")
    docs = bench.select(F.col("item_id").alias("doc_id"), "text")
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 3000)
    got = decontaminate.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in got) == [(i, i) for i in range(40)]


def test_answer_decides(spark):
    rng = np.random.default_rng(3)
    w = words(rng, 40)
    part = " ".join(w[:30])  # three quarters of the item, without its end
    assert leaks(spark, [(1, part)], [(1, " ".join(w))]) == []
    assert leaks(spark, [(1, part)], [(1, " ".join(w), " ".join(w[5:8]))]) == [(1, 1)]


def test_lcs():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = rng.integers(0, 5, 20).tolist(), rng.integers(0, 5, 30).tolist()
        best = np.zeros((21, 31), int)
        for i in range(20):
            for j in range(30):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert decontaminate.lcs(a, b) == best[20, 30]


def test_svd_is_that_of_the_matrix(spark):
    items = table(spark, SF, "benchmark").select("text")
    idf = np.ones(decontaminate.SLOTS)
    row, v = decontaminate.randomised_svd(items, idf, rank=10, rounds=6)
    a = []
    for r in items.collect():
        for s, x in decontaminate._vectors(r["text"], idf):
            line = np.zeros((row >= 0).sum())
            line[row[s]] = x
            a.append(line)
    _, sigma, _ = np.linalg.svd(np.array(a))
    kept = np.linalg.norm(np.array(a) @ v) ** 2
    assert kept > 0.98 * (sigma[:10] ** 2).sum()


def packed(spark, rows, weights=None):
    df = spark.createDataFrame(rows, DOCS).withColumn("queue", F.lit("clash")).withColumn("task", F.lit("clash"))
    return packing.pack(df, Scratch(spark, "t"), weights).collect()


def check_pieces(pieces, texts):
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for doc_id, text in texts.items():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        at = 0
        for p in sorted(by_doc[doc_id], key=lambda p: p["start"]):
            assert p["start"] == at
            assert p["doc_tokens"] == len(ids)
            assert p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == packing.WINDOW or (k == max(by_sequence) and at <= packing.WINDOW)
    return by_sequence


def test_packing_of_the_table(spark):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    windows = check_pieces(packing.op10_mixture_packing(spark, SF).collect(), texts)
    total = Counter()
    for ps in windows.values():
        for p in ps:
            total[p["queue"]] += p["length"]
    share = {q: n / sum(total.values()) for q, n in total.items()}
    # every window but the last few has its mixture, and the deficit never grows
    done = Counter()
    for k in range(len(windows) - 100):
        for p in windows[k]:
            done[p["queue"]] += p["length"]
        assert all(abs(done[q] - share[q] * packing.WINDOW * (k + 1)) < 3 + 0.001 * (k + 1) * packing.WINDOW for q in share)


def test_packing_to_given_proportions(spark):
    texts = {i: " ".join(f"tok{i} {j}" for j in range(400)) for i in range(60)}
    rows = [(i, t, "en", "a" if i % 6 else "b") for i, t in texts.items()]
    windows = check_pieces(packed(spark, rows, {"a": 1, "b": 1}), texts)
    first = Counter()
    for p in windows[0]:
        first[p["queue"]] += p["length"]
    assert first == {"a": 512, "b": 512}
    last = {p["queue"] for p in windows[max(windows) - 1]}
    assert last == {"a"}  # b ran dry


def test_packing_edge_cases(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "<|endoftext|> and <|endoftext|>", "en", "s"), (4, "word " * 30_000, "en", None), (5, "héllo   wörld\n\n  \t", "en", "t")]
    check_pieces(packed(spark, rows), {i: t for i, t, _, _ in rows})
    assert packed(spark, []) == []
    twice = packed(spark, [(1, "a", "en", "s"), (1, "a", "en", "s"), (None, "a", "en", "s")])
    assert len(twice) == 3
    assert packed(spark, rows, {"s": 0, "u": 3})


def test_schedule_serves_everything():
    rng = np.random.default_rng(5)
    for _ in range(10):
        totals = {f"q{i}": int(rng.integers(0, 10**7 if i == 0 else 50_000)) for i in range(int(rng.integers(1, 9)))}
        plan = packing.Schedule(totals)
        sizes = Counter()
        for i, q in enumerate(plan.names):
            at = 0
            while at < totals[q]:
                n = min(int(rng.integers(1, 5000)), totals[q] - at)
                start, length, window, _ = plan.cut(i, at, n)
                assert length.sum() == n
                assert (np.cumsum(length) - length == start).all()
                for w, k in zip(window.tolist(), length.tolist(), strict=True):
                    sizes[w] += k
                at += n
        assert all(sizes[w] == packing.WINDOW for w in range(plan.windows - 1))


@pytest.mark.parametrize("given", [False, True])
def test_packing_of_more_than_512_sources(spark, given):
    """Every source has its share of all windows, one large one and 600 small ones."""
    texts = {i: f"w{i} " * (2 + i % 3) for i in range(600)} | {600 + i: "big one " * 500 for i in range(12)}
    source = {i: f"s{i:03}" if i < 600 else "big" for i in texts}
    weights = {q: 3.0 if q == "big" else 0.001 * (1 + i % 2) for i, q in source.items()} if given else None
    windows = check_pieces(packed(spark, [(i, t, "en", source[i]) for i, t in texts.items()], weights), texts)
    total, done = Counter(), Counter()
    for ps in windows.values():
        for p in ps:
            assert p["queue"] == source[p["doc_id"]]
            total[p["queue"]] += p["length"]
    assert len(total) == 601
    whole = sum((weights or total).values())
    for k in range(len(windows) - 1):
        for p in windows[k]:
            done[p["queue"]] += p["length"]
        if any(done[q] == total[q] for q in total) and given:
            break
        for q, n in (weights or total).items():
            assert abs(done[q] - n / whole * packing.WINDOW * (k + 1)) < (8 if q == "big" else 2)
    assert k > 2


def test_schedule_of_many_queues_has_their_weights(monkeypatch):
    """Against an order of all tokens by due time, in several slices."""
    rng = np.random.default_rng(6)
    totals = {f"q{i}": int(rng.integers(0, 60)) for i in range(2000)} | {"big": 30_000}
    weights = {q: float(rng.integers(0, 4)) for q in totals} | {"big": 900.0}
    monkeypatch.setattr(packing, "SLICE", 5000)
    plan = packing.Schedule(totals, weights)
    assert plan.slices > 10 and plan.names == sorted(totals)
    tokens = sorted((plan.due(i, j), i, j) for i in range(len(plan.names)) for j in range(plan.total[i]))
    want = {(i, j): r // packing.WINDOW for r, (_, i, j) in enumerate(tokens)}
    for i in range(len(plan.names)):
        if plan.total[i]:
            start, length, window, at = plan.cut(i, 0, int(plan.total[i]))
            assert (start == at).all() and length.sum() == plan.total[i]
            assert np.repeat(window, length).tolist() == [want[i, j] for j in range(plan.total[i])]
    first = [want[i, 0] for i, q in enumerate(plan.names) if plan.total[i] and not weights[q]]
    last = [want[i, int(plan.total[i]) - 1] for i, q in enumerate(plan.names) if plan.total[i] and weights[q]]
    assert min(first) >= max(last)  # no weight: after all others


@pytest.mark.parametrize("weights", [None, {"a": 5.0, "b": 2.0, "c": 2.0, "d": 0.5, "e": 0.004}])
def test_schedule_against_a_loop_of_deficits(weights):
    """A plain deficit round-robin, window after window, until a queue runs dry."""
    totals = {"a": 90_000, "b": 60_000, "c": 31_000, "d": 9_000, "e": 400}
    plan = packing.Schedule(totals, weights)
    want = weights or totals
    share = {q: want[q] / sum(want.values()) for q in totals}
    got = defaultdict(Counter)
    for i, q in enumerate(plan.names):
        _, length, window, _ = plan.cut(i, 0, totals[q])
        for w, n in zip(window.tolist(), length.tolist(), strict=True):
            got[w][q] += n
    deficit, left, done = dict.fromkeys(totals, 0.0), dict(totals), Counter()
    for k in range(plan.windows):
        deficit = {q: d + share[q] * packing.WINDOW for q, d in deficit.items()}
        take = {q: int(d) for q, d in deficit.items()}
        for q in sorted(totals, key=lambda q: take[q] - deficit[q])[: packing.WINDOW - sum(take.values())]:
            take[q] += 1
        if any(take[q] > left[q] for q in totals):
            break
        for q, n in take.items():
            deficit[q] -= n
            left[q] -= n
            done[q] += got[k][q] - n
            assert abs(got[k][q] - n) <= 3 and abs(done[q]) <= 2
    assert k > 80


def test_schedule_is_as_large_as_its_queues():
    small, large = (packing.Schedule({f"q{i}": n for i in range(20)}) for n in (10**3, 10**12))
    assert len(pickle.dumps(large)) < len(pickle.dumps(small)) + 100
    start, length, window, at = large.cut(3, 10**11, 2000)
    assert length.sum() == 2000 and (at - start == 10**11).all()
    assert window[0] == large.ranks(3, np.array([10**11]))[0] // packing.WINDOW
    assert abs(int(window[0]) * packing.WINDOW - 20 * 10**11) < 30_000


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "word" + " \n\u3000" * 700_000 + "x " * 1000])
def test_tokens_of_very_long_runs(text):
    path = public_tokenizers.path(packing.TOKENIZER)
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert packing.encoder(path)(text).tolist() == want


def test_packing_of_a_very_long_run(spark):
    rows = [(1, "\n" * 1_200_000, "en", "a"), (2, "some words " * 300, "en", "b"), (3, " " * 60_000 + "end", "en", "b")]
    check_pieces(packed(spark, rows), {i: t for i, t, _, _ in rows})


def test_pipeline_removes_leaks_of_any_doc_id(spark):
    sf = "/root/testdata/sf0.001"
    item = next(r["text"] for r in table(spark, sf, "benchmark").collect() if len(decontaminate.words_of(r["text"])) > 20)
    clean = "nothing of the kind is told in these few words about a garden"
    rows = [(None, item), (None, clean), (7, item), (7, clean), (8, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.decontaminate(spark, docs, sf).collect())
    assert got == Counter([(None, clean), (7, clean), (8, None), (None, None)])


def test_pipeline_keeps_unlike_texts_of_one_doc_id(spark):
    rng = np.random.default_rng(9)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(9, a), (5, a + " end"), (5, b), (5, b), (7, b + " end"), (5, c), (6, None), (None, a), (None, a), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    assert got == Counter([(5, a + " end"), (5, b), (5, c), (6, None), (8, "")])


def test_pipeline_treats_null_doc_ids_like_others(spark):
    rng = np.random.default_rng(10)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(None, a), (None, a), (1, a), (2, a), (None, b), (None, b + " end"), (None, c), (None, None), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect())
    [b_kept] = [t for i, t in got if t in (b, b + " end")]
    assert got == Counter([(1, a), (None, b_kept), (None, c), (None, None), (3, None)])


def without_repeats(text, repeated, length):
    """Bytes that no repeated string covers, and the rest of a character that a cut went through."""
    covered = [False] * len(text)
    for p in range(len(text) - length + 1):
        if text[p : p + length] in repeated:
            covered[p : p + length] = [True] * length
    out, at = b"", 0
    for a in range(len(text)):
        if a and text[a] & 0xC0 == 0x80:
            continue
        end = next((b for b in range(a + 1, len(text)) if text[b] & 0xC0 != 0x80), len(text))
        starts_here = not covered[a]
        # a character stays with its first byte; one whose first byte goes is gone
        if starts_here:
            out += text[max(a, at) : end]
            at = end
    return out.decode()


def test_pipeline_stages_against_brute_force(spark):
    """Each stage on its predecessor's rows, at the smallest size."""
    sf, docs = "/root/testdata/sf0.001", None
    docs = table(spark, sf, "documents").select(corpus_pipeline.COLUMNS)
    scratch = Scratch(spark, "t")
    extra = spark.createDataFrame([(10**6, None, None, "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    docs = docs.unionByName(extra)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = scratch.save(stage(spark, docs, sf), name)
        after = docs.collect()
        seen[name] = len(after)
        if name != "pack":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "language":
            assert {r["doc_id"] for r in after} == set(before) - {10**6, 10**6 + 1}
        if name == "near_duplicates":
            sets = {i: hyperminhash.shingle_set(r["text"]) for i, r in before.items()}
            kept = {r["doc_id"] for r in after}
            for i in set(before) - kept:
                assert any(100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]) for j in before if j != i)
            assert not [(i, j) for i in kept for j in kept if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
        if name == "repeated_spans":
            count = Counter()
            for r in before.values():
                t = r["text"].encode()
                count.update(t[p : p + suffix_index.LENGTH] for p in range(len(t) - suffix_index.LENGTH + 1))
            repeated = {s for s, n in count.items() if n > 1}
            want = {i: without_repeats(r["text"].encode(), repeated, suffix_index.LENGTH) for i, r in before.items()}
            assert any(w != before[i]["text"] for i, w in want.items())
            assert {r["doc_id"]: r["text"] for r in after} == {i: w for i, w in want.items() if w.strip(" ") or w == before[i]["text"]}
            for r in after:
                assert r["n_chars"] == len(r["text"])
                assert "�" not in r["text"] or "�" in before[r["doc_id"]]["text"]
                if not any(before[r["doc_id"]]["text"].encode()[p : p + suffix_index.LENGTH] in repeated for p in range(len(before[r["doc_id"]]["text"].encode()))):
                    assert r["text"] == before[r["doc_id"]]["text"]
        if name == "decontaminate":
            gone = set(before) - {r["doc_id"] for r in after}
            items = [b" ".join(decontaminate.words_of(r["text"])) for r in table(spark, sf, "benchmark").collect()]
            holds = {i for i, r in before.items() if any(t in b" ".join(decontaminate.words_of(r["text"])) for t in items)}
            assert holds <= gone
            assert len(gone) <= len(holds) + 1
        if name == "pack":
            check_pieces(after, {i: r["text"] for i, r in before.items()})
    assert seen["pack"] > 0
