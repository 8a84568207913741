import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from llm.helpers import awkward, awkward_rows, empty
from tidemark.llm import langid, toxicity
from tidemark.llm.common import held_out

SF = "/root/testdata/sf0.1"


def words(n, letters, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def machine():
    texts = [words(40, "abcdefgh", i) + ". " + words(20, "abcdefgh", -i) for i in range(200)]
    toxic = [i % 4 == 0 for i in range(200)]
    texts = [t.replace(" ", f" {('grumpus', 'zonkwit')[i % 8 == 0]} ", 1) if y else t for i, (t, y) in enumerate(zip(texts, toxic, strict=True))]
    return toxicity.fit(texts, [int(y) for y in toxic])


def test_toxicity_tolerates_gaps(machine):
    clean = words(60, "abcdefgh", 999)
    said = ["grumpus", "Grumpus!", "g.r.u.m.p.u.s", "grumxpus", "zonkkwit", "g r u m p u s", "***zonkwit"]
    scores = machine.scores(pa.array([clean, *[f"{clean} {w} {clean}" for w in said], "", None, clean * 500]))
    assert scores[0] < 0.3 and (scores[1:8] >= 0.3).all(), scores
    assert scores[8] == scores[9] < 0.3 and scores[10] < 0.3
    assert ((scores >= 0) & (scores <= 1)).all()


def test_toxicity_tolerates_an_insertion_near_the_start(machine):
    clean = words(60, "abcdefgh", 999)
    assert machine.scores(pa.array([f"{clean} grxumpus {clean}"]))[0] >= 0.3


@pytest.mark.parametrize("word", ["grumpus", "zonkwit"])
def test_toxicity_tolerates_insertions_and_splits_anywhere(machine, word):
    clean = words(60, "abcdefgh", 999)
    said = [word[:i] + c + word[i:] for i in range(1, len(word)) for c in "xae"]
    said += [word[:i] + "x" + word[i : i + 2] + "y" + word[i + 2 :] for i in range(1, len(word) - 2)]
    said += [word[:i] + " " + word[i:] for i in range(1, len(word))]
    said += [word[:i] + " " + word[i:j] + " " + word[j:] for j in range(2, len(word)) for i in range(1, j)]
    scores = machine.scores(pa.array([f"{clean} {w} {clean}" for w in said]))
    assert (scores >= 0.3).all(), [w for w, x in zip(said, scores, strict=True) if x < 0.3]
    # Pieces in two sentences, or of no insult, are words of their own.
    apart = [word[:3] + ". " + word[3:], word[:3] + "\n" + word[3:], word[3:] + " " + word[:3]]
    assert (machine.scores(pa.array([f"{clean} {w} {clean}" for w in apart])) < 0.3).all()


@pytest.mark.parametrize("gap", ["\n", "\t", "\r\n", "\u00a0", "  "])
def test_toxicity_cuts_words_at_all_white_space(machine, gap):
    clean = words(6_000, "abcdefgh", 5)
    said = " ".join([*clean.split()[:3_000], "grumpus", *clean.split()[3_000:]])
    texts = [clean, said, clean.replace(" ", gap), said.replace(" ", gap)]
    scores = machine.scores(pa.array(texts))
    assert scores[2] < 0.3 <= scores[3] and scores[0] < 0.3 <= scores[1], scores
    if gap in ("\t", "  ", "\u00a0"):
        assert np.allclose(scores[:2], scores[2:])
    decisions = machine.decisions(pa.array([f"ab{gap}grumpus{gap}ef", f"ab{gap}grumpus{gap}Grumpus,{gap}ef"]))
    assert np.isclose(*decisions)
    assert toxicity.sentences("a\tb c.\nd\r\ne") == [["a", "b", "c"], ["d"], ["e"]]


def test_kernel_equals_brute_force():
    def counts(word):
        found, word = {}, "^" + word
        n = len(word)
        for i in range(n):
            for j in range(i + 1, n):
                for k in range(j + 1, min(n, i + toxicity.SPAN)):
                    u = word[i] + word[j] + word[k]
                    found[u] = found.get(u, 0) + toxicity.DECAY ** (k - i + 1)
        return found

    def kernel(a, b):
        x, y = counts(a), counts(b)
        dot = lambda p, q: sum(v * q.get(u, 0) for u, v in p.items())
        return (dot(x, y) / np.sqrt(dot(x, x) * dot(y, y))) ** toxicity.POWER if x and y else 0.0

    landmarks, others = ["grumpus", "zonkwit"], ["grxumpus", "zonk", "ab", "a", "", "summer", "grumpus"]
    got = toxicity.KernelMachine(landmarks).kernel(others)
    want = np.array([[kernel(w, m) for m in landmarks] for w in others])
    assert np.allclose(got, want, atol=1e-4)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    hit = rows[rows.toxic == 1].predicted.mean()
    false = rows[rows.toxic == 0].predicted.mean()
    assert hit > 0.8 and false < 0.03, (hit, false)


def test_toxicity_without_labels(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(awkward(spark), labels).collect()
    assert len(rows) == len(awkward_rows()) and {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    odd = spark.createDataFrame([(1, 1, None), (1, 1, 1), (1, 0, 0), (None, 0, 1), (99, 0, 1), (4, 0, 7)], "doc_id long, quality int, toxic int")
    assert len(toxicity.score_documents(awkward(spark), odd).collect()) == len(awkward_rows())
    assert toxicity.score_documents(empty(spark), odd).count() == 0


def test_language_on_held_out_rows(spark):
    rows = langid.identify(spark.read.parquet(f"{SF}/documents.parquet"))
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    found = rows.join(truth, "doc_id").filter("held_out and lang is not null").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97 and found.rejected.mean() < 0.005


def test_language_rejection():
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{SF}/documents.parquet", columns=["text", "lang"]).to_pandas().dropna()
    apart = np.arange(len(rows)) % 4 == 0
    learned, others = rows[~apart].groupby("lang").head(langid.PER_LANGUAGE), rows[apart]
    model = langid.fit(pa.array(learned.text.tolist()), learned.lang.tolist())

    def rejected(texts, by=model):
        return by.predict(pa.array(texts, pa.string()))[2].mean()

    assert rejected(others.text.tolist()) <= 0.01
    random = np.random.default_rng(3)
    letters, consonants = list("abcdefghijklmnopqrstuvwxyz"), list("bcdfghjklmnpqrstvwxz")
    for of in (letters, consonants):
        words = [" ".join("".join(random.choice(of, random.integers(3, 9))) for _ in range(30)) for _ in range(100)]
        assert rejected(words) >= 0.9
    garbled = [bytes(random.integers(128, 256, 200).tolist()).decode("latin-1") for _ in range(100)]
    assert rejected(garbled) >= 0.9
    foreign = [
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan.",
        "すべての人間は、生まれながらにして自由であり、かつ、尊厳と権利とについて平等である。",
        "Omnes homines liberi aequique dignitate atque iuribus nascuntur.",
    ]
    assert rejected(foreign) == 1
    for language in sorted(set(learned.lang)):
        known = learned[learned.lang != language]
        without = langid.fit(pa.array(known.text.tolist()), known.lang.tolist())
        left_out = others[others.lang == language].text
        assert rejected(left_out[left_out.str.len() >= 200].tolist(), without) >= 0.9, language


def test_language_edges(spark):
    rows = {r.doc_id: r for r in langid.identify(awkward(spark)).collect()}
    assert len(rows) == len({r[0] for r in awkward_rows()})
    for i in (2, 3, 10):
        assert (rows[i].lang_pred, rows[i].score, rows[i].rejected) == ("und", 0.0, True)
    assert all(r.lang_pred in ("en", "de", "fr", "und") and 0 <= r.score <= 1 for r in rows.values())
    assert rows[11].lang_pred != "und"
    unlabelled = awkward(spark, clash=False).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(empty(spark)).count() == 0


def test_subwords_equal_brute_force():
    texts = ["Ab c", "", "x1y É.", "hello"]
    bucket, text = langid.subwords(pa.array(texts))
    want = []
    for i, t in enumerate(texts):
        raw = [b if (b > 127 or chr(b).isalpha()) else 32 for b in t.lower().encode()]
        line = [32, *raw, 32]
        for n in (2, 3, 4):
            for a in range(len(line) - n + 1):
                gram = line[a : a + n]
                if (n == 2 and gram == [32, 32]) or (n > 2 and 32 in gram[1:-1]):
                    continue
                h = n
                for c in gram:
                    h = ((h ^ c) * 0x01000193) & 0xFFFFFFFF
                want.append((i, (h ^ (h >> 15)) % langid.BUCKETS))
    assert sorted(zip(text.tolist(), bucket.tolist(), strict=True)) == sorted(want)


def test_held_out_share(spark):
    from pyspark.sql import functions as F

    ids = spark.range(4000).select(held_out(F.col("id")).alias("x"))
    assert 900 < ids.filter("x").count() < 1100


def _peak_mb(job) -> float:
    tracemalloc.start()
    try:
        job()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def _words(n: int, seed: int) -> list[str]:
    random = np.random.default_rng(seed)
    return ["".join(random.choice(list("abcdefghijklmnopqrstuvwxyz"), random.integers(3, 10))) for _ in range(n)]


def test_the_drivers_fits_need_little_memory():
    """Samples as large as the bounds allow: the fits run in the driver, beside
    Spark's own memory."""
    random, words = np.random.default_rng(3), _words(20_000, 3)
    texts = [" ".join(random.choice(words, 300)) for _ in range(1_000)]
    assert _peak_mb(lambda: langid.fit(pa.array(texts), ["xx", "yy"] * 500)) < 130
    rows = random.normal(0, 1, (toxicity.CLEAN_SENTENCES, 80))
    bad = [rows[:1_000] + 1 for _ in range(5)]
    assert _peak_mb(lambda: toxicity._support_vectors(rows, bad)) < 10  # rows: 19 MB, copies of all: three times that


def test_support_vectors_are_those_of_all_examples_at_once():
    """Newton steps summed over steps of rows, against plain ones."""
    random = np.random.default_rng(4)
    clean, toxic = random.normal(0, 1, (2_500, 6)), [random.normal(0.7, 1, (300, 6)), random.normal(1, 1, (40, 6))]
    weight, bias = toxicity._support_vectors(clean, toxic)
    x = np.hstack([np.concatenate([clean, *toxic]), np.ones((2_840, 1))])
    sign = np.repeat([-1.0, 1.0], [2_500, 340])
    cost = np.where(sign > 0, 0.5 / 340, 0.5 / 2_500)
    w = np.append(weight, bias)
    slack = np.maximum(0, 1 - sign * (x @ w))
    gradient = np.append(toxicity.PENALTY * weight, 1e-9 * bias) - x.T @ (cost * sign * slack)
    assert np.abs(gradient).max() < 1e-6
