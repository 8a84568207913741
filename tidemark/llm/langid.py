"""Language identification: averaged hashed subword embeddings under a linear
softmax, with calibrated rejection.

Subwords are the 2- to 4-byte pieces of lower-cased words, their borders
included, hashed into ``BUCKETS`` embeddings. A text's vector is the mean of
its subwords' embeddings, and a linear layer gives the languages' scores;
both are trained by stochastic gradient descent in numpy on the driver, on a
bounded sample. Over the corpus each subword's embedding times the linear
layer is one row of a table (``BUCKETS`` by languages, a fixed size), so a
whole text costs one look-up per subword in an Arrow function.

Scores are softmax probabilities at a temperature fitted on the part of the
sample kept from training. A text is rejected for a low score, below which
``REJECT_RATE`` of that part falls (never over 0.5), or for unfamiliar
subwords: the share of its subwords (under a wider hash) that training saw
less than twice, with ``PRIOR`` familiar ones added, so that short texts aren't
rejected by chance. The limit of that share is the geometric mean of what
``REJECT_RATE`` of the kept-apart texts exceed (``USUAL`` at least) and what nine
in ten texts of every kind outside the known languages exceed: each language's kept-apart texts
as seen without that language's training texts, texts with their letters
shuffled, and words of random letters. With fewer than ``MIN_APART`` kept-apart
texts there is no such limit.

Learned from at most ``PER_LANGUAGE`` rows a language and ``MAX_ROWS`` in all,
of at most ``MAX_BYTES`` each, with lang and text and not held out. Null texts
and texts without a letter are ``und``, score 0 and rejected. Without a row to
learn from every text is. Texts of any length are read whole, step by step.
Equal scores go to the language first in order. Repeated rows are predicted
each; in the sample a doc_id stands for all of its rows. An empty table gives
no rows. Other columns are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, held_out, pick, plain_strings, ship_package, string_bytes, text_bytes

UNKNOWN = "und"
BUCKETS, WIDTH = 1 << 15, 16
PER_LANGUAGE, MAX_ROWS, MAX_BYTES = 250, 5_000, 8 << 10
EPOCHS, RATE, BATCH, WINDOW_BYTES = 4, 0.5, 64, 400
REJECT_RATE = 0.001
#: The hash under which a subword is familiar or not, and when it is.
WIDE, SEEN_TWICE, PRIOR, MIN_APART, USUAL = 1 << 20, 2, 20, 50, 0.01
#: Bytes of text that training and prediction cut at a time.
STEP_BYTES = 1 << 18
#: Examples of each kind of noise, and characters of each.
NOISE, NOISE_CHARS = 200, 1_000
_SIZES = (2, 3, 4)

#: ASCII letters stay, other ASCII bytes are borders, all further bytes stay.
_KEPT = np.array([chr(b).isalpha() or b > 127 for b in range(256)])


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    table: np.ndarray  # BUCKETS x languages
    bias: np.ndarray
    temperature: float
    threshold: float
    familiar: np.ndarray  # WIDE
    limit: float  # of the share of unfamiliar subwords

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether rejected, of every text."""
        texts = plain_strings(texts)
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        logits, strange = self.read(texts)
        chance = softmax(logits / self.temperature)
        best = chance.argmax(axis=1)
        lettered = pc.match_substring_regex(texts, r"\p{L}").to_numpy(zero_copy_only=False)
        names = [self.languages[i] if x else UNKNOWN for i, x in zip(best, lettered, strict=True)]
        scores = np.where(lettered, chance[np.arange(len(best)), best], 0.0)
        return names, scores, ~lettered | (scores < self.threshold) | (strange > self.limit)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Logits and share of unfamiliar subwords of every text."""
        parts = [self._read(texts.slice(a, b - a)) for a, b in byte_slices(texts, STEP_BYTES)]
        if not parts:
            return np.zeros((0, len(self.languages))), np.zeros(0)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])

    def _read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        wide, text = subwords(texts, WIDE)
        strange = unfamiliar(self.familiar, wide, text, len(texts))
        buckets = wide & (BUCKETS - 1)
        counts = np.bincount(text, minlength=len(texts))
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(counts)
        starts = (np.cumsum(counts) - counts)[full]
        for c in range(len(self.languages)):
            if len(full):
                out[full, c] = np.add.reduceat(self.table[:, c][buckets], starts, dtype=np.float64) / counts[full]
        return out + self.bias, strange


def unfamiliar(familiar: np.ndarray, wide: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Each text's share of subwords that aren't ``familiar``."""
    strange = np.bincount(text[~familiar[wide]], minlength=n)
    return strange / (np.bincount(text, minlength=n) + PRIOR)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def subwords(texts: pa.Array, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every subword, in the order of the texts. Among fewer
    buckets (a power of two) a subword's is the lower bits of this one."""
    raw, starts = string_bytes(pc.utf8_lower(texts))
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # A border before and after every text.
    place = np.arange(len(raw)) + np.repeat(np.arange(1, len(starts)), np.diff(starts))
    line = np.full(len(raw) + len(starts), 32, np.uint8)
    line[place] = raw
    kept = _KEPT[line]
    code = np.where(kept, line, 32).astype(np.uint32)
    at, bucket = [], []
    for n in _SIZES:
        m = len(line) - n + 1
        ok = kept[1 : 1 + m].copy() if n > 2 else kept[:m] | kept[1 : 1 + m]
        for j in range(2, n - 1):
            ok &= kept[j : j + m]
        where = np.flatnonzero(ok)
        h = np.full(len(where), n, np.uint32)
        for j in range(n):
            h = (h ^ code[where + j]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        at.append(where)
        bucket.append(h & np.uint32(buckets - 1))
    borders = starts + np.arange(len(starts))
    at, bucket = np.concatenate(at), np.concatenate(bucket)
    text = np.searchsorted(borders, at, "right") - 1
    order = np.argsort(text, kind="stable")
    return bucket[order].astype(np.int64), text[order]


def train(docs: DataFrame, seed: int = 7) -> LanguageModel:
    """Fit on a bounded sample of rows that aren't held out."""
    rows = pick(docs, "doc_id", "text", "lang")
    learnable = rows.filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & text_bytes(F.col("text")).between(1, MAX_BYTES)
    )
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
    ids = learnable.select("doc_id", "lang").withColumn("n", F.row_number().over(by_hash)).filter(F.col("n") <= PER_LANGUAGE)
    ids = ids.orderBy("n", "lang").limit(MAX_ROWS).select("doc_id").distinct()
    # Broadcast: MAX_ROWS ids at most.
    sample = learnable.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "text").limit(MAX_ROWS)
    found = sample.select("text", "lang").toArrow()
    return fit(found["text"], found["lang"].to_pylist(), seed)


def fit(texts: pa.Array, langs: list[str], seed: int = 7) -> LanguageModel:
    texts = plain_strings(texts)
    languages = tuple(sorted(set(langs)))
    if not languages:
        return LanguageModel((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0, np.zeros(WIDE, dtype=bool), 1.0)
    target = np.array([languages.index(x) for x in langs])
    random = np.random.default_rng(seed)
    apart = random.random(len(target)) < 0.2
    # Examples are windows of the training texts, so short texts are known too.
    windows, labels = [], []
    for i in np.flatnonzero(~apart):
        text = texts[int(i)].as_py()
        for a in range(0, len(text), WINDOW_BYTES):
            windows.append(text[a : a + int(random.integers(40, WINDOW_BYTES))])
            labels.append(target[i])
    bucket, ends = _by_window(pa.array(windows, pa.string()))
    embed = random.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    labels = np.array(labels, dtype=np.int64)
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for batch in np.array_split(random.permutation(len(windows)), max(1, len(windows) // BATCH)):
            batch = batch[ends[batch + 1] > ends[batch]]
            if not len(batch):
                continue
            sizes = ends[batch + 1] - ends[batch]
            first = np.cumsum(sizes) - sizes
            mine = bucket[np.repeat(ends[batch] - first, sizes) + np.arange(sizes.sum())]
            mean = np.add.reduceat(embed[mine], first, axis=0) / sizes[:, None]
            error = softmax(mean @ layer + bias)
            error[np.arange(len(batch)), labels[batch]] -= 1
            back = (error @ layer.T) / sizes[:, None]
            layer -= rate * (mean.T @ error) / len(batch) * 4
            bias -= rate * error.mean(axis=0)
            np.subtract.at(embed, mine, np.repeat((rate * back).astype(np.float32), sizes, axis=0))
    table = (embed @ layer).astype(np.float32)
    learned = texts.filter(pa.array(~apart))
    seen = sightings(learned)
    model = LanguageModel(languages, table, bias.astype(np.float64), 1.0, 0.0, seen >= SEEN_TWICE, 1.0)
    if not apart.any():
        return model
    kept = texts.filter(pa.array(apart))
    logits, strange = model.read(kept)
    truth = target[apart]

    def loss(t: float) -> float:
        return -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()

    temperature = min((0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 5.0), key=loss)
    scores = softmax(logits / temperature).max(axis=1)
    threshold = min(0.5, float(np.quantile(scores, REJECT_RATE)))
    limit = 1.0
    if len(kept) >= MIN_APART:
        usual = max(USUAL, float(np.quantile(strange, 1 - REJECT_RATE)))
        kinds = [unfamiliar(model.familiar, *subwords(x, WIDE), len(x)) for x in noise(kept, random)]
        for c in range(len(languages)):
            foreign = kept.filter(pa.array(truth == c))
            others = seen - sightings(learned.filter(pa.array(target[~apart] == c)))
            if len(foreign) >= MIN_APART / 5:
                kinds.append(unfamiliar(others >= SEEN_TWICE, *subwords(foreign, WIDE), len(foreign)))
        strangest = min(float(np.quantile(x, 0.1)) for x in kinds)
        limit = max(usual, float(np.sqrt(usual * strangest)))
    return LanguageModel(languages, table, model.bias, temperature, threshold, model.familiar, limit)


def _by_window(windows: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all windows' subwords in a row, and where each window's begin
    (and the last one's end)."""
    found, sizes = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for a, b in byte_slices(windows, STEP_BYTES):
        bucket, owner = subwords(windows.slice(a, b - a))
        found.append(bucket.astype(np.int32))
        sizes.append(np.bincount(owner, minlength=b - a))
    return np.concatenate(found), np.cumsum(np.concatenate(sizes))


def sightings(texts: pa.Array) -> np.ndarray:
    """How often each wide bucket occurs; the sample is bounded."""
    found = np.zeros(WIDE, np.int64)
    for a, b in byte_slices(texts, STEP_BYTES):
        found += np.bincount(subwords(texts.slice(a, b - a), WIDE)[0], minlength=WIDE)
    return found


def noise(texts: pa.Array, random: np.random.Generator) -> list[pa.Array]:
    """Examples outside every language: the texts with each word's letters
    shuffled, and words of random letters. Of at least ``PRIOR`` words."""
    some = [x.split() for x in texts.slice(0, NOISE).to_pylist()]
    words = [w for x in some for w in x if len(w) > 2]
    drawn = [list(random.permutation(words)[: NOISE_CHARS // 10]) for _ in range(NOISE)] if len(words) >= PRIOR else []
    shuffled = [" ".join("".join(random.permutation(list(w))) for w in x) for x in drawn]
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    random_words = [
        " ".join("".join(random.choice(letters, random.integers(3, 10))) for _ in range(NOISE_CHARS // 20)) for _ in range(NOISE)
    ]
    return [pa.array(x, pa.string()) for x in (shuffled, random_words) if x]


def predict_column(model: LanguageModel, session):
    """An Arrow function from texts to (lang_pred, score, rejected)."""
    shared = session.sparkContext.broadcast(model)  # a fixed number of buckets

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores, rejected = shared.value.predict(texts)
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())],
            ["lang_pred", "score", "rejected"],
        )

    return predict


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    ship_package(docs.sparkSession)
    predict = predict_column(model or train(docs), docs.sparkSession)
    found = pick(docs, "doc_id", "text").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")
