"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds.  Features are the
presence of words and of word beginnings; the expected severity is the sum of the exceedance
probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.shared import materialise, slices, small_batches

#: Labelled documents, toxic and others each, that the model is fitted on.
DOCS_PER_CLASS = 2_000
#: Features that the model may weigh: those whose share of toxic documents is least likely by chance.
VOCABULARY = 600
MIN_DOCS, MIN_Z = 5, 4.0
#: Ridge penalty of the weights.
RIDGE = 1.0
#: Lengths of the word beginnings that are features beside the words themselves.
BEGINNINGS = (4, 5, 6, 7)
#: Characters at the edges of a word that are not part of it.
_EDGE = "".join(chr(c) for c in range(128) if not chr(c).isalnum())


def features_of(text: str | None) -> set[str]:
    """Sparse features of a whole text: its distinct words, their beginnings, and beginnings that two words share.

    Words are lower-cased and stripped of ASCII punctuation.  A beginning is marked with a hyphen,
    one of two or more distinct words with two.
    """
    words = {w.strip(_EDGE) for w in set((text or "").lower().split())}
    words.discard("")
    found = set(words)
    add = found.add
    for word in words:
        size = len(word)
        for n in BEGINNINGS:
            if size < n:
                break
            begin = word[:n] + "-"
            if begin in found:
                add(begin + "-")
            else:
                add(begin)
    return found


@dataclass
class Model:
    """Weights by feature and the ordered thresholds between grades."""

    weights: dict[str, float]
    thresholds: np.ndarray

    def margin(self, text: str | None) -> float:
        weights = self.weights
        return sum(weights[f] for f in features_of(text) if f in weights)


def fit(found: list[list[str]], grades: np.ndarray, telling: list[str], l2: float = RIDGE, steps: int = 30) -> Model:
    """Maximum likelihood with a ridge penalty, by Fisher scoring with step halving, from each document's telling features."""
    levels = max(1, int(grades.max())) if len(grades) else 1
    place = {f: i for i, f in enumerate(telling)}
    n, width = len(found), len(place)
    x = np.zeros((n, width), np.float32)
    for i, features in enumerate(found):
        x[i, [place[f] for f in features]] = 1
    above = np.array([(grades > k).mean() if n else 0.5 for k in range(levels)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(np.log((1 - above) / above) + 1e-3 * np.arange(levels))
    values = np.concatenate([np.zeros(width), start])
    if not n:
        return Model({}, start)

    def parts(values):
        exceed = _sigmoid((x @ values[:width])[:, None] - values[None, width:])  # P(grade > k)
        ends = np.concatenate([np.ones((n, 1)), exceed, np.zeros((n, 1))], axis=1)
        chances = np.maximum(ends[:, :-1] - ends[:, 1:], 1e-12)
        return exceed * (1 - exceed), chances

    def loss(values):
        if (np.diff(values[width:]) <= 0).any():
            return np.inf
        return -np.log(parts(values)[1][np.arange(n), grades]).sum() + l2 / 2 * (values[:width] ** 2).sum()

    now = loss(values)
    for _ in range(steps):
        slope, chances = parts(values)
        own = chances[np.arange(n), grades]
        # of the log likelihood, by each margin z - theta_k; and its expected second derivatives
        first = np.stack([slope[:, k] / own * ((grades == k + 1).astype(float) - (grades == k)) for k in range(levels)], axis=1)
        second = np.zeros((n, levels, levels))
        for k in range(levels):
            second[:, k, k] = slope[:, k] ** 2 * (1 / chances[:, k] + 1 / chances[:, k + 1])
            if k:
                second[:, k, k - 1] = second[:, k - 1, k] = -slope[:, k] * slope[:, k - 1] / chances[:, k]
        by_k = second.sum(axis=2)
        gradient = np.concatenate([x.T @ first.sum(axis=1) - l2 * values[:width], -first.sum(axis=0)])
        information = np.zeros((width + levels, width + levels))
        information[:width, :width] = x.T @ (x * by_k.sum(axis=1)[:, None]) + l2 * np.eye(width)
        information[:width, width:] = -(x.T @ by_k)
        information[width:, :width] = information[:width, width:].T
        information[width:, width:] = second.sum(axis=0) + 1e-9 * np.eye(levels)
        move = np.linalg.solve(information, gradient)
        share = 1.0
        while share > 1e-4 and not (following := loss(values + share * move)) < now:
            share /= 2
        if share <= 1e-4 or now - following < 1e-6 * abs(now):
            break
        values, now = values + share * move, following
    return Model({f: float(values[i]) for f, i in place.items()}, values[width:])


def _telling(counts: list[tuple[str, int, int]], share: float, vocabulary: int) -> list[str]:
    """Of features (name, documents, toxic documents) those of MIN_DOCS or more with the largest z-scores, MIN_Z at least, against independence of toxicity."""
    spread = max(share * (1 - share), 1e-9)
    scored = ((abs(high - n * share) / (n * spread) ** 0.5, f) for f, n, high in counts if n >= MIN_DOCS)
    return [f for _, f in sorted((-z, f) for z, f in scored if z >= MIN_Z)[:vocabulary]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def train(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_class: int = DOCS_PER_CLASS) -> Model:
    """Fit on whole texts of a sample of graded documents, as many of grade 0 as of higher grades, about per_class at most.

    graded: (id_col, grade from 0 up).  Rows without a grade or a text are not learnt from; an id
    graded twice is learnt from twice.  The sample is drawn by a hash of the id.  Features are counted
    where the texts are; what reaches the driver is the VOCABULARY most telling features and which of
    them each sampled document has, whatever the size of the texts.

    Where grades above 0 all are 1, a yes or no, they are graded by degree: a document is of grade 2 if
    it has more telling features that speak for toxicity, as a share of its words, than the median of
    them, and of grade 1 otherwise.
    """
    small_batches(docs.sparkSession)
    known = graded.where("grade is not null").select(F.col(id_col).cast("long").alias("g_id"), F.col("grade").cast("int"))
    sizes = dict(known.groupBy((F.col("grade") > 0).alias("high")).count().collect())
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("g_id")), F.lit(1_000_000))
    wanted = min([per_class, *sizes.values()])  # as many of either, so that one telling word is enough
    share = {high: min(1_000_000, int(1e6 * wanted / n) + 1) for high, n in sizes.items()}
    picked = known.where(draw < F.when(F.col("grade") > 0, share.get(True, 0)).otherwise(share.get(False, 0)))
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("text"))

    def extract(batches):
        for batch in slices(batches):
            ids, grades, found = batch.column(0), batch.column(1), [features_of(t) for t in batch.column(2).to_pylist()]
            words = pa.array([sum(not f.endswith("-") for f in own) for own in found], pa.int32())
            yield pa.RecordBatch.from_arrays([ids, grades, words, pa.array([sorted(f) for f in found], pa.list_(pa.string()))], names=["id", "grade", "words", "features"])

    # the sample is bounded by its parameter, two numbers a document
    rows = texts.join(F.broadcast(picked), F.col("d_id") == F.col("g_id")).select("d_id", "grade", "text")
    rows = materialise(rows.mapInArrow(extract, "id long, grade int, words int, features array<string>"), "features")
    n, high = rows.agg(F.count("*"), F.count(F.when(F.col("grade") > 0, 1))).first()
    counted = rows.select(F.explode("features").alias("f"), (F.col("grade") > 0).cast("int").alias("high"))
    counted = counted.groupBy("f").agg(F.count("*").alias("n"), F.sum("high").alias("high")).where(F.col("n") >= MIN_DOCS)
    overall = high / n if n else 0.5
    score = F.abs(F.col("high") - F.col("n") * overall) / F.sqrt(F.col("n") * max(overall * (1 - overall), 1e-9))
    best = counted.orderBy(score.desc(), "f").limit(VOCABULARY).collect()
    telling = _telling([tuple(r) for r in best], overall, VOCABULARY)
    speaking = {r["f"] for r in best if r["f"] in set(telling) and r["high"] > r["n"] * overall}
    held = F.array_intersect("features", F.array(*[F.lit(f) for f in telling])) if telling else F.array().cast("array<string>")
    sample = sorted(rows.select("id", "grade", "words", held.alias("held")).collect(), key=lambda r: (r["id"], r["grade"], r["words"], r["held"]))
    grades = np.array([r["grade"] for r in sample], np.int64)
    if grades.max(initial=0) == 1:
        degree = np.array([sum(f in speaking for f in r["held"]) / max(1, r["words"]) for r in sample])
        grades = np.where((grades == 1) & (degree > np.median(degree[grades == 1])), 2, grades)
    return fit([r["held"] for r in sample], grades, telling)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """One row per input row: (id_col, *keep, p_toxic, severity, grade, toxic).

    p_toxic: probability of any grade above 0; severity: expected grade; grade: the median
    one, above 0 just where the row is toxic; toxic: p_toxic >= 0.5.  Null and empty texts have no word and get the base rates.  Rows
    that repeat come back as often as they came; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        rows.schema.fields[:-1]
        + [T.StructField(*f) for f in (("p_toxic", T.DoubleType()), ("severity", T.DoubleType()), ("grade", T.IntegerType()), ("toxic", T.BooleanType()))]
    )

    def run(batches):
        for batch in slices(batches):
            model = shared.value
            z = np.array([model.margin(text) for text in batch.column(batch.num_columns - 1).to_pylist()], np.float64)
            exceed = _sigmoid(z[:, None] - model.thresholds[None, :])
            grade = (exceed >= 0.5).sum(axis=1).astype(np.int32)
            found = [exceed[:, 0], exceed.sum(axis=1), grade, exceed[:, 0] >= 0.5]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + [pa.array(x) for x in found], names=schema.names)

    return rows.mapInArrow(run, schema)


def grades_from_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Grades from the label toxic: 0 or 1; train grades the toxic ones by degree."""
    return labels.select(id_col, F.col("toxic").cast("int").alias("grade"))
