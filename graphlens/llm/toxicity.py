"""Toxicity scores by boosted trees over dense features, with isotonic calibration.

The lexicon is learnt: words and word beginnings that are far likelier in toxic
than in other training texts. A text becomes a short vector of lexicon
densities, nearness of lexicon words to second-person words, capitals,
punctuation and obfuscation rates, whatever its length. Spark's gradient-boosted
trees learn on one part of the training rows, an isotonic regression turns their
probabilities into calibrated scores on another. Scoring is one pass over the
table without a shuffle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import map_batches, materialize

#: Labelled rows that the model is fitted on, at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 12_000
#: Terms of the lexicon, at most, and what a term needs: toxic texts, log odds, and their distance from 0 in standard errors.
LEXICON, SUPPORT, ODDS, SURE = 5_000, 3, 1.5, 3.0
#: Lengths of word beginnings that count as terms besides whole words.
STEMS = (4, 5, 6)
THRESHOLD = 0.7
#: Words between a lexicon word and a second-person word that still count as near.
NEAR = 4
TREES, DEPTH, SEED = 20, 3, 7
_KNOWN = 300_000

#: Second-person words of the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself ye u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinen ihr euch euer eure sie ihnen usted ustedes tú ti tus vos vosotros vuestro su sus os".split()
)
#: Characters that stand for letters.
LOOKALIKES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[^\W\d_][\d@$!*|#%&]+[^\W\d_]")
_AGAIN = re.compile(r"(.)\1{2,}")
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())

FEATURES = ("hits", "density", "weight", "strongest", "distinct", "hidden", "near", "second", "capitals", "loud", "punctuation", "shouts", "obfuscated", "drawn", "length")


def terms(word: str) -> list[str]:
    """A word's lexicon terms: itself and its beginnings, marked by a hyphen."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """Raw token to a small code; ``weights`` and ``kinds`` tell what a code means."""

    def __init__(self, weights: dict[str, float]):
        self.terms = weights
        self.codes: dict[tuple, int] = {(0.0, 0): 0}
        self.weights, self.kinds, self.stale = [0.0], [0], True

    def weight(self, word: str) -> float:
        return max((self.terms.get(t, 0.0) for t in terms(word)), default=0.0)

    def __missing__(self, token: str) -> int:
        word = _EDGE.sub("", token)
        low = word.lower()
        weight = self.weight(low) if low else 0.0
        kind = (low in SECOND_PERSON) | (len(word) > 1 and word.isupper()) << 1
        if _INSIDE.search(token):
            kind |= 4
            plain = self.weight(_EDGE.sub("", token.lower().translate(LOOKALIKES)))
            if plain > weight:
                weight, kind = plain, kind | 16
        if _AGAIN.search(low):
            kind |= 8
            plain = self.weight(_AGAIN.sub(r"\1", low))
            if plain > weight:
                weight, kind = plain, kind | 16
        code = self.codes.setdefault((weight, kind), len(self.codes))
        if code == len(self.weights):
            self.weights.append(weight)
            self.kinds.append(kind)
            self.stale = True
        if len(self) >= _KNOWN:
            self.clear()
        self[token] = code
        return code

    def tables(self):
        if self.stale:
            self._tables, self.stale = (np.array(self.weights), np.array(self.kinds)), False
        return self._tables


def features(text: str, lexicon: Lexicon) -> list[float]:
    """The dense vector of a whole text; all zeros for an empty one."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return [0.0] * len(FEATURES)
    codes = np.fromiter(map(lexicon.__getitem__, tokens), np.int64, n)
    weights, kinds = lexicon.tables()
    weight, kind = weights[codes], kinds[codes]
    at, you = np.flatnonzero(weight > 0), np.flatnonzero(kind & 1)
    hits = len(at)
    if hits and len(you):
        right = np.searchsorted(you, at)
        gap = np.minimum(np.abs(you[np.minimum(right, len(you) - 1)] - at), np.abs(you[np.maximum(right - 1, 0)] - at))
        near = float((gap <= NEAR).mean())
    else:
        near = 0.0
    raw = text.encode()
    letters = len(raw) - len(raw.translate(None, _LETTERS)) or 1
    capitals = len(raw) - len(raw.translate(None, _UPPER))
    marks = len(raw) - len(raw.translate(None, _PUNCTUATION))
    return [
        math.log1p(hits), hits / n, float(weight[at].sum()) / n, float(weight.max()), math.log1p(len(np.unique(codes[at]))), float((kind & 16 > 0).sum()), near, len(you) / n,
        capitals / letters, float((kind & 2 > 0).mean()), marks / len(raw), raw.count(b"!") / n, float((kind & 4 > 0).mean()), float((kind & 8 > 0).mean()), math.log1p(n),
    ]


def _vectors(texts: list[str], lexicon: Lexicon) -> pa.Array:
    return pa.array([features(t, lexicon) for t in texts], pa.list_(pa.float64()))


def held_out(doc_id) -> F.Column:
    """Rows that no label is ever learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``doc_id, text, toxic, fold, calibrates`` of at most ``rows`` labelled documents outside the held-out third.

    A repeated id counts once, with its smallest text.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    known = known.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by ``rows``, hence broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    one = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(2)).cast("int")).withColumn("calibrates", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(4)) == 0)


def _lexicons(train: DataFrame) -> list[dict[str, float]]:
    """Three lexicons: learnt without fold 0, without fold 1, and on all training rows."""

    def count(batch):
        held = Counter()
        for text, toxic, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold"))):
            words = {_EDGE.sub("", t) for t in set(text.lower().split())}
            held.update({(t, fold, toxic) for w in words if w for t in terms(w)})
        keys = list(held)
        columns = [pa.array([k[i] for k in keys], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([held[k] for k in keys], pa.int64())], ["term", "fold", "toxic", "n"])

    unique = train.dropDuplicates(["text"]).select("text", "toxic", "fold")
    sizes = {(r["fold"], r["toxic"]): r["count"] for r in unique.groupBy("fold", "toxic").count().collect()}
    counted = map_batches(unique, count, "term string, fold int, toxic int, n long")
    cell = lambda fold, toxic: F.sum(F.when((F.col("fold") == fold) & (F.col("toxic") == toxic), F.col("n")).otherwise(0)).alias(f"n{fold}{toxic}")
    table = counted.groupBy("term").agg(*[cell(f, t) for f in (0, 1) for t in (0, 1)])
    likely = table.filter(F.col("n01") + F.col("n11") >= SUPPORT)
    odds = F.log((F.col("n01") + F.col("n11") + 0.5) / (F.col("n00") + F.col("n10") + 0.5))
    top = likely.orderBy(odds.desc(), (F.col("n01") + F.col("n11")).desc(), "term").limit(4 * LEXICON).collect()
    out = []
    for folds in ((1,), (0,), (0, 1)):
        toxic, clean = (sum(sizes.get((f, t), 0) for f in folds) for t in (1, 0))
        found = {}
        for r in top:
            p, q = (sum(r[f"n{f}{t}"] for f in folds) for t in (1, 0))
            odds = math.log((p + 0.5) / (toxic - p + 0.5)) - math.log((q + 0.5) / (clean - q + 0.5))
            if p >= SUPPORT and odds >= ODDS and odds / math.sqrt(1 / (p + 0.5) + 1 / (q + 0.5)) >= SURE:
                found[r["term"]] = odds
        out.append(dict(sorted(found.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]))
    return out


class Model:
    """A fitted lexicon, trees and calibration; ``constant`` where the labels teach nothing."""

    def __init__(self, lexicon, trees=None, calibration=None, constant=0.0):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant

    def apply(self, vectors: DataFrame) -> DataFrame:
        """Adds ``score`` from the array column ``vector``."""
        if self.trees is None:
            return vectors.withColumn("score", F.lit(float(self.constant))).drop("vector")
        out = self.trees.transform(vectors.withColumn("features", array_to_vector("vector"))).withColumn("_p", vector_to_array("probability")[1])
        if self.calibration is None:
            out = out.withColumn("score", F.col("_p"))
        else:
            out = self.calibration.transform(out).withColumn("score", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
        return out.drop("vector", "features", "rawPrediction", "probability", "prediction", "_p")


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """The model of the training rows of ``labels``; labels of the held-out third are never read."""
    train = materialize(training_rows(docs, labels, rows), "train")
    sizes = {(r["toxic"], r["calibrates"]): r["count"] for r in train.groupBy("toxic", "calibrates").count().collect()}
    toxic = sum(n for (t, _), n in sizes.items() if t)
    if not sizes.get((1, False)) or not sizes.get((0, False)):
        return Model({}, constant=toxic / max(1, sum(sizes.values())))
    lexicons = _lexicons(train)

    def vectors(batch):
        own = [Lexicon(x) for x in lexicons[:2]]
        made = [features(t, own[f]) for t, f in zip(batch.column("text").to_pylist(), batch.column("fold").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), batch.column("calibrates"), pa.array(made, pa.list_(pa.float64()))], ["toxic", "calibrates", "vector"])

    made = materialize(map_batches(train.select("text", "fold", "toxic", "calibrates"), vectors, "toxic int, calibrates boolean, vector array<double>"), "vectors")
    made = made.withColumn("features", array_to_vector("vector")).withColumn("label", F.col("toxic").cast("double"))
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=SEED, featuresCol="features", labelCol="label").fit(made.filter("NOT calibrates"))
    if not sizes.get((1, True)) or not sizes.get((0, True)):
        return Model(lexicons[2], trees)
    judged = trees.transform(made.filter("calibrates")).withColumn("_p", vector_to_array("probability")[1]).select("_p", "label")
    calibration = IsotonicRegression(featuresCol="_p", labelCol="label", predictionCol="score").fit(judged)
    return Model(lexicons[2], trees, calibration)


def score_documents(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), rows: int = TRAIN_ROWS) -> DataFrame:
    """The columns ``keep`` and ``held_out, score, predicted`` of every document.

    Only the whole text decides a score. Missing and empty texts are scored as
    texts without features. A missing ``doc_id`` counts as held out; labels that
    are missing, not 0 or 1, or without id are ignored; of several labels of one
    id the largest counts. Without labels of both kinds every score is the share
    of toxic training rows. Repeated rows get equal scores; an empty table gives
    no rows; columns besides ``keep`` are ignored.
    """
    model = fit(docs, labels, rows)
    text = "text" if "text" in keep else "_text"
    base = docs.select(*[F.col(c) for c in keep], F.col("doc_id").alias("_id"), *([] if text in keep else [F.col("text").cast("string").alias(text)]))
    base = base.withColumn("held_out", held_out(F.col("_id"))).drop("_id")
    weights = model.lexicon
    carried = [*keep, "held_out"]

    def score(batch):
        if "lexicon" not in made:
            made["lexicon"] = Lexicon(weights)
        found = pa.array([features(t.as_py() or "", made["lexicon"]) for t in batch.column(text)], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in carried], found], [*carried, "vector"])

    made: dict[str, Lexicon] = {}  # of a task, built with its first batch
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema if f.name in carried)
    scored = model.apply(map_batches(base, score, schema + ", vector array<double>"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
