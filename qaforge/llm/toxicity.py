"""Toxicity scores: subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (with word ends), hashed into one table, so a misspelt
word shares much of its vector with the word it stands for. A passage's vector is the mean over its words (words that say
the last or last but one again left out), and a linear softmax gives the passage's class. Table and softmax are trained jointly in numpy. A text is
as toxic as its most toxic passage, so that a long text does not hide a short insult.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .shared import bounded_batches, crc_rest, doc_text, table
from .words import mix

BUCKETS = 1 << 19
SIZES = (3, 4, 5)
PASSAGE = 48  # words; passages of a text overlap by half
GROUP = 1 << 17  # bytes of text scored at once, a longer text by itself
LEAST = 24  # a shorter passage's mean is taken as if words of no weight filled it up
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ALNUM = np.ones(0x110000, bool)
_ALNUM[:0x3000] = [chr(i).isalnum() for i in range(0x3000)]
_STATE: dict = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_STATE.get("powers", ((),))[0]) < n:
        size = 1 << (n - 1).bit_length()
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p, dtype=np.uint64))
        _STATE["powers"] = tuple(out)
    return _STATE["powers"]


class Bag:
    """The words of some texts, their distinct forms, and the n-gram buckets of each form."""

    def __init__(self, texts: list[str]):
        lowered = [t.lower() for t in texts]
        lengths = [len(t) for t in lowered]
        code = np.frombuffer("".join(["\n", *(t + "\n" for t in lowered)]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        inside = _ALNUM[code]
        code = np.where(inside, code, 1).astype(np.uint64)  # one mark for all that stands between words
        starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
        begin = np.cumsum([1, *(n + 1 for n in lengths)])
        self.first = np.searchsorted(starts, begin)  # each text's first word
        power, inverse = _powers(len(code) + 1)
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * power[: len(code)], out=total[1:])
        whole = mix((total[ends + 1] - total[starts - 1]) * inverse[starts - 1])
        new = np.ones(len(whole), bool)
        for lag in (1, 2):
            new[lag:] &= whole[lag:] != whole[:-lag]
        new[self.first[:-1][self.first[:-1] < len(new)]] = True
        self.first = np.concatenate([[0], np.cumsum(new)])[self.first]
        starts, ends, whole = starts[new], ends[new], whole[new]
        _, rep, self.form = np.unique(whole, return_index=True, return_inverse=True)
        starts, ends, own = starts[rep] - 1, ends[rep] + 1, np.arange(len(rep))
        grams, of = [], []
        for n in SIZES:
            count = np.maximum(ends - starts - n + 1, 0)
            word = np.repeat(own, count)
            at = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + starts[word]
            grams.append(mix((total[at + n] - total[at]) * inverse[at] + np.uint64(n)))
            of.append(word)
        of = np.concatenate(of)
        order = np.argsort(of, kind="stable")
        self.bucket = (np.concatenate(grams)[order] & np.uint64(BUCKETS - 1)).astype(np.int32)
        self.size = np.bincount(of, minlength=len(rep)).astype(np.int32)  # n-grams of each form
        self.begin = (np.cumsum(self.size) - self.size).astype(np.int32)
        self.form = self.form.astype(np.int32)

    def passages(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last word (excluded) of each passage, and its text."""
        a, b, text = [], [], []
        for t, (lo, hi) in enumerate(zip(self.first[:-1].tolist(), self.first[1:].tolist())):
            for at in range(lo, max(lo + 1, hi - PASSAGE // 2), PASSAGE // 2):
                if hi > lo:
                    a.append(at)
                    b.append(min(at + PASSAGE, hi))
                    text.append(t)
        return np.array(a, np.int64), np.array(b, np.int64), np.array(text, np.int64)


    def words(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of the n-grams of words a to b (excluded), and their weights in the mean over these words."""
        forms = self.form[a:b]
        size = self.size[forms]
        at = np.repeat(self.begin[forms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        bucket, place = np.unique(self.bucket[at], return_inverse=True)
        return bucket, np.bincount(place, np.repeat(1 / size, size)) / max(LEAST, b - a)


class Model:
    """s[bucket]: what an n-gram adds to the logit of the toxic class (its scaled vector times the difference of the two
    softmax rows), and the bias. Vectors have more dimensions in training; a score needs no more than this product."""

    def __init__(self, s: np.ndarray, bias: float):
        self.s, self.bias = s, bias

    def passage_logits(self, bag: Bag, passages=None) -> tuple[np.ndarray, np.ndarray]:
        a, b, text = passages or bag.passages()
        if not len(a):
            return np.zeros(0), text
        of_form = np.add.reduceat(self.s[bag.bucket], bag.begin) / bag.size
        total = np.concatenate([[0.0], np.cumsum(of_form[bag.form])])
        return self.bias + (total[b] - total[a]) / np.maximum(b - a, LEAST), text

    def score(self, texts: list[str]) -> np.ndarray:
        """0 to 1 for each text; the bias alone scores a text without words."""
        out = np.full(len(texts), self.bias)
        logits, text = self.passage_logits(Bag(texts))
        if len(text):
            at = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
            out[text[at]] = np.maximum.reduceat(logits, at)
        return 1 / (1 + np.exp(-np.clip(out, -60, 60)))


def train(texts: list[str], labels: list[int], dims: int = 4, epochs: int = 12, smooth: float = 2.0, power: float = 1.5, seed: int = 1) -> Model:
    """Joint stochastic gradient descent on vectors and softmax.

    Each n-gram's vector is scaled by how unlike the shares of the two classes' texts are that hold it, so that n-grams of a
    few texts move little. Steps are normalised by the length of their gradient; the mean of the later epochs is kept. Of a
    text's passages, the one that scores highest stands for it. The bias never exceeds the log ratio of the classes, so a
    passage of n-grams that training has not seen is not toxic for that. Without texts of both classes every score is 0.5.
    """
    bags = [(y, bag, bag.passages()) for y, t in zip(labels, texts) if len((bag := Bag([t])).form)]
    share, n = np.zeros((2, BUCKETS)), np.bincount([y for y, _, _ in bags], minlength=2)
    if not n.all():
        return Model(np.zeros(BUCKETS), 0.0)
    for y, bag, _ in bags:
        share[y, np.unique(bag.bucket)] += 1
    extra = 2 * smooth * n[:, None] / n.sum()  # in proportion, so that an n-gram of few texts speaks for no class
    share = (share + extra) / (n[:, None] + 2 * extra)
    scale = np.abs(np.log(share[1] / share[0])) ** power
    rng = np.random.default_rng(seed)
    vectors, softmax, bias = rng.normal(0, 1e-4, (BUCKETS, dims)), np.stack([-np.ones(dims), np.ones(dims)], 1) / (2 * dims**0.5), (prior := float(np.log(n[1] / n[0])))
    kept, kept_bias, n_kept = np.zeros(BUCKETS), 0.0, 0
    for epoch in range(epochs):
        rate = 1 - epoch / epochs
        for i in rng.permutation(len(bags)):
            y, bag, passages = bags[i]
            turn = softmax[:, 1] - softmax[:, 0]
            of_form = np.add.reduceat((vectors[bag.bucket] @ turn) * scale[bag.bucket], bag.begin) / bag.size
            total = np.concatenate([[0.0], np.cumsum(of_form[bag.form])])
            logits = bias + (total[passages[1]] - total[passages[0]]) / np.maximum(passages[1] - passages[0], LEAST)
            best = int(logits.argmax())
            bucket, weight = bag.words(int(passages[0][best]), int(passages[1][best]))
            weight = weight * scale[bucket]
            mean = weight @ vectors[bucket]
            error = 1 / (1 + np.exp(-np.clip(logits[best], -60, 60))) - y
            step = rate * error / max(1e-12, (weight @ weight) * (turn @ turn) + 2 * (mean @ mean))
            vectors[bucket] -= step * weight[:, None] * turn[None, :]
            softmax[:, 1] -= step * mean
            softmax[:, 0] += step * mean
            bias = min(prior, bias - rate * 0.05 * error)
        if epoch >= epochs // 2:
            kept += (vectors @ (softmax[:, 1] - softmax[:, 0])) * scale
            kept_bias, n_kept = kept_bias + bias, n_kept + 1
    return Model(kept / n_kept, kept_bias / n_kept)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500) -> Model:
    """A model of docs (doc_id, text) and labels (doc_id, toxic).

    The bias follows the share of toxic texts among all labels. The rest is learnt from a bounded sample: of each class the
    per_class labelled documents of the smallest hashes of their ids, with their whole texts. Of rows that repeat an id, the text of the smallest hash stands for it, so the sample is of
    2 * per_class texts at most; its bytes are bounded by that many times the longest text. A document labelled more than once
    counts as toxic if one label says so; null labels and labels without a document are left out.
    """
    bounded_batches(docs.sparkSession)
    classes = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    n, n_toxic = classes.agg(F.count("*"), F.count(F.when(F.col("toxic") == 1, 1))).first()
    rank = F.xxhash64("doc_id", F.lit(17))
    sample = classes.where("toxic = 1").orderBy(rank, "doc_id").limit(per_class).unionByName(classes.where("toxic = 0").orderBy(rank, "doc_id").limit(per_class))
    rows = doc_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = rows.select("toxic", "text")  # 2 * per_class rows at most

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [r for batch in batches for r in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist())]
        got.sort()  # the same model whatever the order of rows
        model = train([t for t, _ in got], [int(y) for _, y in got])
        learnt, of = sum(int(y) for _, y in got), len(got)
        del got
        words.trim()
        yield pa.RecordBatch.from_arrays([pa.array([model.s.astype("<f8").tobytes()]), pa.array([model.bias]), pa.array([learnt]), pa.array([of - learnt])], ["s", "bias", "toxic", "clean"])

    # The bounded sample is learnt in one task; the driver gets BUCKETS numbers.
    found = rows.repartition(1).mapInArrow(learn, "s binary, bias double, toxic long, clean long").first()
    if not found:
        return Model(np.zeros(BUCKETS), 0.0)
    model = Model(np.frombuffer(found["s"], "<f8"), found["bias"])
    if 0 < n_toxic < n and found["toxic"] and found["clean"]:
        # The sample's own ratio of the classes is in the bias already.
        model.bias += float(np.log(n_toxic / (n - n_toxic)) - np.log(found["toxic"] / found["clean"]))
    return model


def with_scores(docs: DataFrame, model: Model, threshold: float = 0.7, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score (0 to 1) and a prediction (1 if the score reaches the threshold) in the columns so named.

    Only the text is looked at. Null and empty texts are scored by the bias. All rows and other columns stay; columns of
    these two names are replaced. Texts of any length are scored whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.s.astype(np.float32), model.bias))  # BUCKETS numbers

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        s, bias = shared.value
        own = Model(s.astype(np.float64), bias)
        for batch in batches:
            yield pa.array(np.concatenate([own.score(part.to_pylist()) for _, part in words.groups(batch, GROUP)] or [np.zeros(0)]), pa.float64())

    scored = docs.withColumn(score_col, score(F.coalesce(F.col("text"), F.lit(""))))
    return scored.withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))


def learnable(labels: DataFrame) -> DataFrame:
    """The labels that may be learnt from: those whose crc32(doc_id) mod 3 is not 1."""
    return labels.where(crc_rest(F.col("doc_id"), 3) != 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable(table(spark, sf_dir, "labels")))
    held_out = F.coalesce(crc_rest(F.col("doc_id"), 3) == 1, F.lit(False))
    return with_scores(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
