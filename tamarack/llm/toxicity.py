"""Toxicity by a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the hashed embeddings of the word and of its first letters (so inflected
forms share one). Filters of width 1, 2 and 3 slide over the words of the whole text, max pooling keeps the
strongest answer of each filter, and a logistic layer reads the pooled values. A threshold for each
language is calibrated on all labelled rows that the fit did not see, weighted to the label counts of the input; the language is told from function words of the
text itself, and the score is shifted so that 0.5 is that language's threshold.

A table is scored in one pass: logits and languages of all its rows are written once, the thresholds come from those of
the labelled rows, and the scores follow from both. No text is shuffled but the bounded sample that is fitted.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.common import added, documents, free_name, removed, text_udf, written

#: Documented bounds of the training sample: rows of either label, and characters of a sampled text.
MAX_POSITIVE, MAX_NEGATIVE, MAX_CHARS = 2000, 3000, 20_000
BUCKETS, DIM, WIDTHS, FILTERS = 1 << 17, 16, (1, 2, 3), 4
PREFIXES = (3, 4, 5)
EPOCHS, RATE = 12, 0.15
#: Every KEPT-th row of the sample stays out of the fit. Logits are counted in bins of 1 / BINS, from -SPAN to SPAN.
KEPT, BINS, SPAN = 4, 1024, 64
MAX_WORDS, CHUNK = 150_000, 1 << 16
WORD = re.compile(r"[^\W\d_]+")
#: Common function words that tell the languages of the corpus apart.
FUNCTION_WORDS = {
    "en": "the of and is that for it was on are with as this be at by from or",
    "de": "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "le les et des un du une dans qui au sur pas plus par pour avec ce il",
    "es": "el los del las por con una su para es al lo como más se sus y",
}
LANGUAGES = tuple(FUNCTION_WORDS)
_LANGUAGE_OF = {w: i for i, words in enumerate(FUNCTION_WORDS.values()) for w in words.split()}


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def buckets_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its first 3, 4 and 5 bytes. Bucket 0 stays empty."""
    raw = word.encode("utf-8", "replace")
    crc, n, last = zlib.crc32, len(raw), BUCKETS - 1
    out = [1 + crc(raw) % last]
    out += [1 + crc(raw[:k], 60) % last if n >= k else 0 for k in PREFIXES]
    return out


@dataclass
class Model:
    """Weights of the classifier; all zero (score 0) where nothing could be learned."""

    embedding: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    thresholds: dict[int, float] = field(default_factory=dict)
    trained: bool = False

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        bias = [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS]
        out = np.abs(rng.normal(0.5, 0.1, len(WIDTHS) * FILTERS)).astype(np.float32)
        return cls(np.zeros((BUCKETS, DIM), dtype=np.float32), filters, bias, out, 0.0)

    def packed(self) -> dict:
        """What workers need: embedding rows that were learned, and the small tensors."""
        rows = np.flatnonzero(np.abs(self.embedding).sum(axis=1))
        return {"rows": rows, "values": self.embedding[rows], "filters": self.filters, "bias": self.bias, "out": self.out, "out_bias": self.out_bias, "thresholds": self.thresholds, "trained": self.trained}


def fit(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Train on labelled texts; every KEPT-th of them is kept for the thresholds."""
    model = Model.fresh(seed)
    y = np.array(labels, dtype=np.float32)
    if len(set(labels)) < 2:
        return model
    vocabulary: dict[str, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], dtype=np.int64) for t in texts]
    feats = np.array([buckets_of(w) for w in vocabulary] or [[0] * (1 + len(PREFIXES))], dtype=np.int64)
    order = np.arange(len(docs))
    calibration = order % KEPT == KEPT - 1
    train = order[~calibration]
    rng = np.random.default_rng(seed)
    emb, acc = model.embedding, np.full(BUCKETS, 1e-3, dtype=np.float32)
    grow = max(1.0, float((y[train] == 0).sum()) / max(1.0, float((y[train] == 1).sum())))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / (EPOCHS + 1))
        for d in rng.permutation(train):
            ids = docs[d]
            if not len(ids):
                continue
            f = feats[ids]
            x = emb[f].sum(axis=1)
            pooled, where = _pool(model, x)
            act = np.tanh(pooled)
            p = 1 / (1 + np.exp(-np.clip(act @ model.out + model.out_bias, -30, 30)))
            g = (p - y[d]) * (grow if y[d] else 1.0)
            if abs(g) < 0.02:
                continue
            back = g * model.out * (1 - act * act)
            model.out -= np.float32(rate * 0.1) * (g * act + np.float32(1e-4) * model.out)
            model.out_bias -= rate * 0.1 * float(g)
            rows, grads = [], []
            for k, w in enumerate(WIDTHS):
                b = back[k * FILTERS : (k + 1) * FILTERS]
                model.bias[k] -= np.float32(rate * 0.05) * b
                for j in range(w):
                    at = where[k] + j
                    ok = at < len(ids)
                    if not ok.any():
                        continue
                    kernel = model.filters[k][j]  # (DIM, FILTERS)
                    gx = (kernel * b).T[ok]  # (n, DIM)
                    hit = at[ok]
                    kernel[:, ok] -= np.float32(rate * 0.05) * (x[hit].T * b[ok])
                    rows.append(f[hit].ravel())
                    grads.append(np.repeat(gx, f.shape[1], axis=0))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            np.add.at(acc, rows, (grads * grads).sum(axis=1))
            np.subtract.at(emb, rows, np.float32(rate) * grads / np.sqrt(acc[rows])[:, None])
            emb[0] = 0
    model.trained = True
    scorer = Scorer(model.packed())
    held = order[calibration]
    logits, langs = scorer.logits([texts[i] for i in held])
    model.thresholds = calibrated(logits, logits, logits, langs, y[held], 1 - y[held])
    return model


def _pool(model: Model, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    pooled, where = [], []
    n = len(x)
    for k, w in enumerate(WIDTHS):
        conv = x @ model.filters[k][0]
        for j in range(1, w):
            conv[: n - j] += (x[j:] @ model.filters[k][j])[: n - j] if n > j else 0
        at = conv.argmax(axis=0)
        where.append(at)
        pooled.append(conv[at, np.arange(FILTERS)] + model.bias[k])
    return np.concatenate(pooled), where


def calibrated(bins: np.ndarray, low: np.ndarray, high: np.ndarray, langs: np.ndarray, toxic: np.ndarray, clean: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> dict[int, float]:
    """Threshold on the logit for each language (and -1: all): least weighted errors, half way between the neighbours.

    Each entry is a bin of logits of one language: its least and greatest logit, and its toxic and clean rows;
    ``weights`` count a toxic and a clean row.
    """

    def best(mine: np.ndarray) -> float:
        _, at = np.unique(bins[mine], return_inverse=True)
        n = int(at.max()) + 1
        bottom, top = np.full(n, np.inf), np.full(n, -np.inf)
        np.minimum.at(bottom, at, low[mine])
        np.maximum.at(top, at, high[mine])
        t, c = np.bincount(at, toxic[mine], n), np.bincount(at, clean[mine], n)
        missed = np.concatenate(([0], np.cumsum(t)))
        rejected = np.concatenate((np.cumsum(c[::-1])[::-1], [0]))
        wrong = weights[0] * missed + weights[1] * rejected
        cuts = np.flatnonzero(wrong <= wrong.min() * (1 + 1e-9))
        cut = int(cuts[len(cuts) // 2])
        return float(((top[cut - 1] if cut else bottom[0] - 1) + (bottom[cut] if cut < n else top[-1] + 1)) / 2)

    if not toxic.sum() or not clean.sum():
        return {-1: 0.0}
    out = {-1: best(np.ones(len(bins), dtype=bool))}
    for lang in range(len(LANGUAGES)):
        mine = langs == lang
        if toxic[mine].sum() >= 8 and clean[mine].sum() >= 8:
            out[lang] = best(mine)
    return out


class Scorer:
    """Scores whole texts; keeps the filter answers of known words in one bounded table."""

    def __init__(self, packed: dict):
        self.model = packed
        kernel = np.concatenate([f[j] for f in packed["filters"] for j in range(len(f))], axis=1)  # (DIM, positions * FILTERS)
        self.columns = kernel.shape[1]
        self.answers = np.zeros((len(packed["rows"]) + 1, self.columns), dtype=np.float32)
        self.answers[1:] = packed["values"] @ kernel
        self.row_of = np.zeros(BUCKETS, dtype=np.int32)
        self.row_of[packed["rows"]] = np.arange(1, len(packed["rows"]) + 1)
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, self.columns), dtype=np.float32)
        self.lang = np.full(1024, -1, dtype=np.int8)

    def _learn(self, new: list[str]) -> None:
        need = len(self.known) + 1
        if need > len(self.table):
            size = max(need, 2 * len(self.table))
            self.table = np.concatenate((self.table, np.zeros((size - len(self.table), self.columns), dtype=np.float32)))
            self.lang = np.concatenate((self.lang, np.full(size - len(self.lang), -1, dtype=np.int8)))
        rows = self.row_of[np.array([buckets_of(w) for w in new], dtype=np.int64)]
        self.table[need - len(new) : need] = self.answers[rows].sum(axis=1)
        self.lang[need - len(new) : need] = [_LANGUAGE_OF.get(w, -1) for w in new]

    def logits(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language index or -1) of every text; texts without words get the bias alone."""
        pooled = np.full((len(texts), len(WIDTHS) * FILTERS), -np.inf, dtype=np.float32)
        votes = np.zeros((len(texts), len(LANGUAGES)), dtype=np.int64)
        ids: list[int] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            if ids:
                self._score(np.array(ids, dtype=np.int64), owners, pooled, votes)
                ids.clear()
                owners.clear()
            if len(self.known) > MAX_WORDS:
                self._clear()

        for d, text in enumerate(texts):
            words = words_of(text)
            for start in range(0, len(words), CHUNK):
                part = words[start : start + CHUNK + max(WIDTHS) - 1]  # overlaps, so no window is lost
                rows = list(map(self.known.get, part))
                if None in rows:
                    new = list(dict.fromkeys(w for w, r in zip(part, rows, strict=True) if r is None))
                    at = len(self.known) + 1
                    self.known.update(zip(new, range(at, at + len(new)), strict=True))
                    self._learn(new)
                    rows = list(map(self.known.get, part))
                owners.append((d, len(rows)))
                ids += rows
                ids += [0] * (max(WIDTHS) - 1)
                if len(ids) >= CHUNK:
                    flush()
        flush()
        bias = np.concatenate(self.model["bias"])
        act = np.tanh(np.where(np.isfinite(pooled), pooled, 0) + bias)
        langs = np.where(votes.sum(axis=1) > 0, votes.argmax(axis=1), -1)
        # summed row by row, so that a text has the same logit in any batch
        return (act.astype(np.float64) * self.model["out"]).sum(axis=1) + self.model["out_bias"], langs

    def _score(self, ids: np.ndarray, owners: list, pooled: np.ndarray, votes: np.ndarray) -> None:
        pad = max(WIDTHS) - 1
        docs = np.array([d for d, _ in owners])
        sizes = np.array([n for _, n in owners])
        starts = np.concatenate(([0], np.cumsum(sizes + pad)[:-1]))
        lang = self.lang[ids]
        hits = np.flatnonzero(lang >= 0)
        cell = docs[np.searchsorted(starts, hits, side="right") - 1] * len(LANGUAGES) + lang[hits]
        votes += np.bincount(cell, minlength=votes.size).reshape(votes.shape)
        bounds = np.stack((starts, starts + sizes), axis=1).ravel()
        table, column = np.take(self.table, ids, axis=0), 0
        for k, w in enumerate(WIDTHS):
            conv = table[:, column : column + FILTERS].copy()
            for j in range(1, w):
                conv[: len(ids) - j] += table[j:, column + j * FILTERS : column + (j + 1) * FILTERS]
            column += w * FILTERS
            most = np.maximum.reduceat(np.concatenate((conv, conv[-1:])), bounds, axis=0)[::2]
            np.maximum.at(pooled[:, k * FILTERS : (k + 1) * FILTERS], docs, most)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not self.model["trained"]:
            return np.zeros(len(texts))
        logits, langs = self.logits(texts)
        cut = self.model["thresholds"]
        shift = np.array([cut.get(int(x), cut.get(-1, 0.0)) for x in langs])
        return 1 / (1 + np.exp(-np.clip(logits - shift, -40, 40).astype(np.float64)))


def is_held_out(id_col: str):
    """Rows that never train: crc32 of the id as text, modulo 5, is 0."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def _fitted(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str) -> tuple[Model, DataFrame, list]:
    """The fitted model, the written (sample_id, sample_label) of all labelled rows that are not held out, and the ids the fit saw."""
    ids = written(labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label).alias("sample_label")), "labelled")
    picks = [ids.where(F.col("sample_label") == v).orderBy(F.xxhash64("sample_id"), "sample_id").limit(n) for v, n in ((1, MAX_POSITIVE), (0, MAX_NEGATIVE))]
    bounded = written(picks[0].unionByName(picks[1]), "sample")
    rows = docs.select(F.col(id_col).alias("sample_id"), F.col(text).alias("sample_text")).where(F.length("sample_text").between(1, MAX_CHARS))
    chosen = rows.join(F.broadcast(bounded), "sample_id").groupBy("sample_id", "sample_label").agg(F.min("sample_text").alias("sample_text"))
    got = chosen.collect()  # at most MAX_POSITIVE + MAX_NEGATIVE rows of at most MAX_CHARS characters
    removed(bounded)
    got.sort(key=lambda r: (zlib.crc32(str(r["sample_id"]).encode()), r["sample_id"]))
    model = fit([r["sample_text"] for r in got], [r["sample_label"] for r in got])
    return model, ids, [(r["sample_id"],) for i, r in enumerate(got) if i % KEPT != KEPT - 1]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows that are not held out; thresholds come from all others of these rows.

    At most MAX_POSITIVE and MAX_NEGATIVE ids, in the order of a hash of the id, and of those the texts of
    at most MAX_CHARS characters. Null ids, labels and texts do not train; of an id with several labels the highest
    counts, of its texts the smallest is fitted and every one counts for the thresholds. Without rows of both labels
    nothing is learned and every score is 0.
    """
    return _logits(docs, labels, id_col, text, label, [id_col])[0]


def _logits(docs: DataFrame, labels: DataFrame, id_col: str, text: str, label: str, columns: list[str]) -> tuple[Model, DataFrame, str]:
    """The trained model, the written ``columns`` of all rows of ``docs`` with a struct of logit and language, and its name."""
    model, ids, seen = _fitted(docs, labels, id_col, text, label)
    packed = docs.sparkSession.sparkContext.broadcast(model.packed())  # a model of fixed size
    make = text_udf(docs.sparkSession, lambda: _logit_batch(packed), "logit double, lang int, words boolean")
    z = free_name(docs, "z")
    table = written(docs.select(*columns, make(F.col(text)).alias(z)), "logits")
    if model.trained:
        scored = table.select(F.col(id_col).alias("sample_id"), f"{z}.*").where("words").join(ids, "sample_id")
        model.thresholds = _thresholds(scored, docs.sparkSession.createDataFrame(seen, ids.select("sample_id").schema)) or model.thresholds
    removed(ids)
    return model, table, z


def _thresholds(scored: DataFrame, seen: DataFrame) -> dict[int, float]:
    """Thresholds from ``scored`` (sample_id, sample_label, logit, lang), less the ids in ``seen``.

    Only counts by language, label and bin of the logit come to the driver. The fit takes more of one label than of the
    other, so what is left counts by the labels of all rows.
    """
    marked = scored.join(F.broadcast(seen.withColumn("fitted", F.lit(True))), "sample_id", "left")
    place = F.floor(F.greatest(F.lit(-SPAN), F.least(F.lit(SPAN), F.col("logit"))) * BINS)
    of = lambda v: F.sum((F.col("sample_label") == v).cast("long"))
    counts = marked.groupBy("fitted", "lang", place.alias("bin")).agg(F.min("logit").alias("low"), F.max("logit").alias("high"), of(1).alias("toxic"), of(0).alias("clean")).toArrow()
    fitted, lang, bins, low, high, toxic, clean = (counts[c].to_numpy() for c in ("fitted", "lang", "bin", "low", "high", "toxic", "clean"))
    free = np.array([x is None or x != x for x in fitted], dtype=bool)
    if not toxic[free].sum() or not clean[free].sum():
        return {}
    weights = float(toxic.sum() / toxic[free].sum()), float(clean.sum() / clean[free].sum())
    return calibrated(bins[free], low[free], high[free], lang[free], toxic[free], clean[free], weights)


def _logit_batch(packed):
    scorer = Scorer(packed.value)

    def batch(texts: list) -> dict:
        logits, langs = scorer.logits(texts)
        return {"logit": logits.astype(np.float64), "lang": langs.astype(np.int32), "words": [bool(t) for t in texts]}

    return batch


def _score(model: Model, z: str):
    """The calibrated score of a logit and its language as a column."""
    if not model.trained:
        return F.lit(0.0)
    shift = F.lit(float(model.thresholds.get(-1, 0.0)))
    for lang, cut in sorted(model.thresholds.items()):
        if lang >= 0:
            shift = F.when(F.col(f"{z}.lang") == lang, F.lit(float(cut))).otherwise(shift)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col(f"{z}.logit") - shift))))


def _score_batch(packed):
    scorer = Scorer(packed.value)
    return lambda texts: {"score": scorer.scores(texts)}


def with_score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``df`` and, as its last column, the calibrated score of every whole text (0 to 1); 0.5 or more is toxic.

    Null and empty texts score like a text without words; equal texts score alike. The column is called
    ``out``; where ``df`` has that name, underscores come in front.
    """
    packed = df.sparkSession.sparkContext.broadcast(model.packed())  # a model of fixed size
    make = text_udf(df.sparkSession, lambda: _score_batch(packed), "score double")
    return added(df, out, make(F.col(text))["score"])


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay as they are.

    Null and empty texts, null ids and repeated rows are scored like any other row. Empty in, empty out.
    """
    model, table, z = _logits(docs, labels, id_col, text, label, docs.columns)
    return table.where(_score(model, z) < 0.5).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: doc_id, held_out, score and predicted of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model, table, z = _logits(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "text", "toxic", ["doc_id"])
    scored = table.select("doc_id", F.coalesce(is_held_out("doc_id"), F.lit(False)).alias("held_out"), _score(model, z).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
