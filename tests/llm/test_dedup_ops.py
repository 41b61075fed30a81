"""Jaccard join, substring dedup, vectors, classifiers and the pipeline against brute force."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm import jaccard, quality, substrings, toxicity, vectors
from kerbline.llm.shingles import words


def sentence(rng, n, vocab=4000):
    return " ".join(f"w{rng.randrange(vocab)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def brute(texts):
    sets = {}
    for i, t in texts:
        w = words(t)
        sets.setdefault(i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        k = len(sets[a] & sets[b])
        if k and 100 * k >= 80 * (len(sets[a]) + len(sets[b]) - k):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_jaccard_join_matches_brute_force(spark):
    rng = random.Random(3)
    base, passage = sentence(rng, 90), sentence(rng, 60)
    texts = [sentence(rng, rng.randrange(6, 120)) for _ in range(40)]
    texts += [edited(rng, base, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.02, 0.03, 0.05, 0.1) for _ in range(6)]
    texts += [" ".join(base.split()[:n]) for n in range(55, 90, 4)]  # shorter and shorter
    texts += [sentence(rng, 30) + " " + passage + " " + sentence(rng, 30) for _ in range(15)]
    texts += ["A b", "a  B", "a b c", "", "  ", None, None, "x " * 3000, "X " * 2999]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "x", 0) for i, t in rows] + [(0, texts[0], "x", 0), (None, "a b c d e f", "x", 0)], "doc_id long, text string, digest string, n int").repartition(3)
    got = jaccard.jaccard_join(df).collect()
    want = brute(rows)
    assert len(got) == len(rows) + 2
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_shingles"], r["component_id"]) == (2, None)
        else:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]], r
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_substring_dedup(spark):
    rng = random.Random(5)
    passage, variant = sentence(rng, 70), None
    variant = passage.replace(passage.split()[30], "changed")
    clean = [sentence(rng, 40) + "\n" + sentence(rng, 30) for _ in range(10)]
    texts = [sentence(rng, 30) + " " + passage + " " + sentence(rng, 25), sentence(rng, 12) + "\n" + passage + "\nend of it", variant, *clean, clean[0], "", None, "short", "short", (sentence(rng, 9) + " again. ") * 300]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)] + [(None, passage, 7)], "doc_id long, text string, idx int").repartition(2)
    got = {r["doc_id"]: r for r in substrings.dedup(df).collect()}
    assert got[0]["text"] == texts[0] and all(got[i]["text"] == texts[i] for i in range(3, 13)) and got[None]["text"] == passage
    assert got[1]["text"].startswith(texts[1].split("\n")[0]) and got[1]["text"].endswith("end of it")
    left = set(zip(*(got[1]["text"].split()[k:] for k in range(20)))) & set(zip(*(passage.split()[k:] for k in range(20))))
    assert not left  # nothing of the passage that is twenty words long
    assert got[2]["text"] == "" and got[13]["text"] == "" and got[14]["text"] == "" and got[15]["text"] is None and got[17]["text"] == "short" and got[18]["text"] == texts[18]
    for i in (1, 2, 13):
        assert all(0 <= s["start"] < s["end"] <= len(texts[i]) for s in got[i]["removed_spans"]) and got[i]["idx"] == 7
    assert substrings.dedup(df.limit(0)).count() == 0


def broken(text, sizes):
    """The text's words in lines of the given sizes, in turn."""
    w, out, k = text.split(), [], 0
    while w:
        out.append(" ".join(w[: sizes[k % len(sizes)]]))
        w, k = w[sizes[k % len(sizes)] :], k + 1
    return "\n".join(out)


@pytest.mark.parametrize("one, two", [((2, 3, 1), (2, 3, 1)), ((11,), (7,)), ((3,), (60,))])
def test_passages_in_any_lines(spark, one, two):
    rng = random.Random(9)
    made = [(sentence(rng, 50), sentence(rng, 20), sentence(rng, 20), sentence(rng, 20)) for _ in range(20)]
    texts = [broken(a + " " + p, one) for p, a, _, _ in made] + [broken(b, two) + "\n" + broken(p, two) + "\n" + c for p, _, b, c in made]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    for i, (p, _, b, c) in enumerate(made):
        left = got[20 + i].split()
        assert got[i] == texts[i] and left == b.split() + c.split()  # the passage is gone to the word


def test_only_repeats_are_removed(spark):
    rng = random.Random(10)
    head, foot, own = sentence(rng, 30), sentence(rng, 30), broken(sentence(rng, 300), (3, 2, 1))
    x, y = sentence(rng, 8), sentence(rng, 8)
    texts = [head + "\n" + foot, head + "\n" + own + "\n" + foot, sentence(rng, 9) + "\n" + x, sentence(rng, 9) + "\n" + y, sentence(rng, 9) + "\n" + x + "\n" + y]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    assert got[1].strip() == own and all(got[i] == texts[i] for i in (0, 2, 3, 4))


def test_short_lines_are_no_passages(spark):
    rng = random.Random(12)
    notice, greeting = sentence(rng, 13), sentence(rng, 9)
    texts = [sentence(rng, 40) + "\n" + notice + "\n" + sentence(rng, 40) + "\n" + greeting for _ in range(30)]
    df = spark.createDataFrame([(i, t, 2**60 + i if i else None) for i, t in enumerate(texts)] + [(0, texts[0], None)], "doc_id long, text string, _lost long")
    rows = substrings.dedup(df.repartition(2)).collect()
    assert len(rows) == 31 and all(r["text"] == texts[r["doc_id"]] and not r["removed_spans"] for r in rows)
    assert all(r["_lost"] == (2**60 + r["doc_id"] if r["doc_id"] else None) for r in rows)


def test_similar_paragraphs_match_all_pairs(spark):
    rng = random.Random(13)
    texts = []
    for _ in range(12):
        base = sentence(rng, 120)
        texts += [base] + [" ".join(w if i != at else "new" for i, w in enumerate(base.split())) for at in (3, 40, 77)]  # similarity 0.9
    texts += [sentence(rng, 60) for _ in range(20)]
    rng.shuffle(texts)
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    want = brute(list(enumerate(texts)))
    assert all((got[i] == texts[i]) == (want[i][1] == i) and (got[i] == "" or want[i][1] == i) for i in want)


def test_a_copy_of_each_passage_stays(spark):
    rng = random.Random(11)
    page, inner = sentence(rng, 400), sentence(rng, 60)
    w = page.split()
    texts = [page, " ".join(w[:200] + [inner] + w[200:]), *(sentence(rng, 30) + " " + inner + " " + sentence(rng, 30) for _ in range(2))]
    got = {r["doc_id"]: r["text"] for r in substrings.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)).collect()}
    assert got[0] == texts[0] and got[1] == "" and got[2] == texts[2]
    assert got[3].split() == texts[3].split()[:30] + texts[3].split()[-30:]


def test_cutting_keeps_the_rest():
    assert substrings.without("ab cd ef\ngh", [(3, 5)]) == "ab ef\ngh"
    assert substrings.without("ab\ncd\nef", [(3, 5)]) == "ab\nef" and substrings.without("ab", [(0, 2)]) == ""
    assert substrings.without("ab cd\nef", [(3, 5)]) == "ab \nef"


def test_band_recall():
    rng = np.random.default_rng(1)
    hits = 0
    for _ in range(200):
        s = rng.integers(0, 2**63, 100, dtype=np.uint64)
        t = np.concatenate([s[:89], rng.integers(0, 2**63, 11, dtype=np.uint64)])  # similarity 0.80
        hits += bool(set(substrings.bands(np.unique(s)).tolist()) & set(substrings.bands(np.unique(t)).tolist()))
    assert hits >= 190


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 16))
    v = [*base, *(base[0] + rng.normal(size=(40, 16)) * 0.05), *(base[1:20] + rng.normal(size=(19, 16)) * 0.05), base[5], base[5], base[5] * 2]
    labels = [i % 2 for i in range(60)] + [0] * 40 + [(i + 1) % 2 for i in range(19)] + [1, 1, 1]
    rows = [(i, [float(x) for x in a], int(k)) for i, (a, k) in enumerate(zip(v, labels))]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, rows[5][1], None), (905, [], 1), (906, [1.0, 2.0], 1), (None, rows[5][1], 1)]
    df = spark.createDataFrame(rows + odd + [rows[3]], "vec_id long, embedding array<double>, label int").repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_duplicates(df, block=7, window=6).collect()}
    x = np.array(v) / np.linalg.norm(v, axis=1, keepdims=True)
    link = (x @ x.T >= 0.93) & (np.array(labels)[:, None] == np.array(labels))
    np.fill_diagonal(link, False)
    comp = list(range(len(v)))
    for _ in v:
        comp = [min([comp[i], *(comp[j] for j in np.nonzero(link[i])[0])]) for i in range(len(v))]
    assert all(got[i] == (int(link[i].sum()), comp[i], comp[i] == i) for i in range(len(v)))
    assert all(got[i] == (0, i, True) for i in range(900, 907)) and got[None] == (0, None, None)
    assert vectors.near_duplicates(df.limit(0)).count() == 0


def test_vectors_recall_in_a_large_label(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(20_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.normal(size=(300, 64))
    y -= (y * x[:300]).sum(axis=1, keepdims=True) * x[:300]
    y = 0.935 * x[:300] + np.sqrt(1 - 0.935**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    df = spark.createDataFrame(list(enumerate(np.concatenate([x, y]).tolist())), "vec_id long, embedding array<double>").withColumn("label", F.lit(1))
    got = {r["vec_id"]: r["component_id"] for r in vectors.near_duplicates(df).where("n_links > 0").collect()}
    assert sum(got.get(20_000 + i) == i for i in range(300)) >= 294


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        bad, junk = rng.random() < 0.2, rng.random() < 0.3
        w = sentence(rng, rng.randrange(30, 120), 800).split()
        if junk:
            w = [x.upper() + "!!" for x in w[:10]] * 4
        if bad:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(["idiot", "moron", "Zorkle" + rng.choice("abcd"), "zorkles"]))
        docs.append((i, " ".join(w), "fr", "src", i))
        labels.append((i, int(not junk), int(bad)))
    docs += [(1000, None, None, None, None), (1001, "", "x", "x", 1), (None, "moron", "x", "x", 1)]
    labels += [(1000, None, None), (None, 1, 1), (5000, 1, 1), (3, labels[3][1], labels[3][2])]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, label, key="doc_id"):
    rows = scored.where("held_out").join(labels.dropDuplicates(["doc_id"]).where(F.col(label).isNotNull()), key).select("predicted", label).collect()
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_toxicity_held_out(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    few = toxicity.training_rows(docs.unionByName(docs).unionByName(docs), labels, "toxic", 100)
    assert few.count() == 100  # however often a document stands there
    out = toxicity.score(docs, model)
    assert accuracy(out, labels, "toxic") > 0.97
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == 703 and 0 <= got[1000]["score"] < 0.5 and got[1000]["score"] == got[1001]["score"] and got[None]["predicted"] == 1 and got[None]["held_out"] is False
    assert any("zorkle".startswith(t) for kind, t in model.voters if kind in "pq")
    bare = toxicity.fit(docs, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(docs.where("doc_id IS NULL OR doc_id = 1001"), bare).collect()} == {0, 1}
    assert toxicity.score(docs.limit(0), bare).count() == 0


def test_label_model_discounts_copies():
    rng = np.random.default_rng(3)
    y = rng.random(2000) < 0.3
    vote = lambda hit, false: np.where(y, rng.random(2000) < hit, rng.random(2000) < false)
    a, b = vote(0.6, 0.01), vote(0.5, 0.01)
    posterior, one, zero, discount = toxicity.label_model(np.stack([a, a, a, b], axis=1).astype(float), 0.3)
    assert discount[0] < 0.5 and discount[0] < discount[3] and one[0] > 10 * zero[0] and ((posterior > 0.5) == y).mean() > 0.9


def test_quality_held_out(spark, labelled):
    docs, labels = labelled
    stats = quality.measured(docs)
    out = quality.score(stats, quality.fit(stats, labels)).withColumnRenamed("id", "doc_id")
    assert accuracy(out, labels, "quality") > 0.97 and out.count() == 703
    small = quality.fit(stats, labels.where("doc_id < 150"))  # calibrated on left-out folds: no worse than the base rate
    assert accuracy(quality.score(stats, small).withColumnRenamed("id", "doc_id"), labels, "quality") > 0.75
    assert quality.score(stats.limit(0), small).count() == 0
    assert out.where("score < 0 OR score > 1 OR score IS NULL").count() == 0
    assert {r["score"] for r in quality.score(stats.limit(3), quality.fit(stats, labels.limit(0))).collect()} <= {0.5, 0.4995 + 0.0005, 0.999 * 0.5 + 0.0005}
    assert quality.isotonic(np.array([1.0, 0, 3]), np.array([1.0, 1, 4])).tolist() == [0.5, 0.5, 0.75]
    assert len(quality.statistics("A b\n\nA b")) == len(quality.STATISTICS) and len(quality.statistics(None)) == len(quality.STATISTICS)


def test_pipeline_stages(spark, labelled, tmp_path):
    import corpus_pipeline as p

    docs, labels = labelled
    rng = random.Random(6)
    leak = sentence(rng, 20)
    copy = docs.where("doc_id = 2").select(F.lit(2000).cast("long").alias("doc_id"), "text", "lang", "source", "score")
    more = spark.createDataFrame([(2001, "before it " + leak + " after", "x", "x", 1)], docs.schema)
    docs.unionByName(copy).unionByName(more).withColumnRenamed("score", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    frame = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = [{r["doc_id"] for r in frame.collect()}]
    for k, (_, stage) in enumerate(p.STAGES[:-1]):
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        out.write.parquet(str(tmp_path / f"s{k}"))
        frame = spark.read.parquet(str(tmp_path / f"s{k}"))
        kept.append({r["doc_id"] for r in frame.collect()})
    toxic = {r["doc_id"] for r in labels.where("toxic = 1 AND doc_id < 1000").collect()}
    assert len(kept[1] & toxic) < 0.1 * len(toxic) and len(kept[0] - kept[1] - toxic - {None}) < 10
    assert 2000 not in kept[2] and (2 in kept[2] or 2 not in kept[1]) and 2001 in kept[3] and 2001 not in kept[4]
    pieces = p.STAGES[-1][1](spark, frame, str(tmp_path))
    assert {r["doc_id"] for r in pieces.collect()} == kept[4]
