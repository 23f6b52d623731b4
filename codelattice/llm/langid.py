"""Language ID by interpolated Kneser-Ney character models in sorted hash arrays.

Per language an interpolated Kneser-Ney model over letters and word gaps; all languages share one
sorted array of n-gram hashes per order, with a row of probabilities per n-gram and a row of
back-off weights per context.  A text gets the language of the lowest cross-entropy per character;
thresholds fitted on held-back training documents say when even the best language does not fit.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codelattice.llm.shared import slices, small_batches

#: Longest n-gram; four characters of 16 bits fill a 64-bit key exactly.
ORDER = 4
#: Training documents per language: the bound of the labelled sample that the models are fitted on.
DOCS_PER_LANGUAGE = 2_000
#: A text is rejected beyond so many median deviations from its language's median cross-entropy, each
#: taken as at least this share of the median; languages with fewer held-back documents share theirs.
SPREADS, LEAST_SPREAD, FEW_HELD = 35, 0.01, 20
#: Characters that are scored at once.
BLOCK = 400_000
GAP, EDGE, OTHER = 32, 1, 2
UNDETERMINED = "und"


@functools.lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> 16-bit symbol: lower-case letter, or the word gap; rare planes share one symbol."""
    table = np.full(0x110000, GAP, np.uint16)
    for point in range(0x110000):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            value = ord(low) if len(low) == 1 else point
            table[point] = value if value < 0x10000 else OTHER
    return table


def _symbols(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts with runs of gaps made one, each text led by order - 1 edges, and each symbol's text."""
    pad = "\x00" * (order - 1)
    joined = "".join(pad + t for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.array([len(t) + order - 1 for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    symbols = _letters()[points]
    starts = np.cumsum(sizes) - sizes
    edge = np.zeros(len(points), bool)
    edge[(starts[:, None] + np.arange(order - 1)[None, :]).ravel()] = True
    symbols[edge] = EDGE
    repeat = np.zeros(len(points), bool)
    repeat[1:] = (symbols[1:] == GAP) & ((symbols[:-1] == GAP) | (symbols[:-1] == EDGE))
    keep = ~repeat
    return symbols[keep].astype(np.uint64), owner[keep]


def _ngrams(symbols: np.ndarray, order: int) -> np.ndarray:
    """The packed n-gram that ends at each symbol from place order - 1 on."""
    packed = np.zeros(max(0, len(symbols) - order + 1), np.uint64)
    for k in range(order):
        packed = (packed << np.uint64(16)) | symbols[k : len(symbols) - order + 1 + k]
    return packed


def _hash(packed: np.ndarray, length: int) -> np.ndarray:
    """A mixing permutation of 64-bit keys, so unequal n-grams of a length never collide."""
    x = packed + np.uint64(length * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Model:
    """Sorted hash arrays for n-grams and contexts of each length, and what calibration found."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]  # by length - 1: sorted hashes
    logs: list[np.ndarray]  # natural log of the interpolated probability, a row per n-gram
    contexts: list[np.ndarray]  # by length - 1: sorted hashes of contexts of n-grams of that length
    backoff: list[np.ndarray]  # log of the weight that the context leaves to the shorter one
    floor: np.ndarray  # log probability of a symbol never seen
    center: np.ndarray = None  # cross-entropy per language, and the limit beyond which it is rejected
    limit: np.ndarray = None
    temperature: float = 1.0


def fit_counts(counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> Model:
    """Interpolated Kneser-Ney from each language's packed n-grams of the full order and their counts."""
    languages = sorted(counts)
    tables = {}  # (language, length) -> packed n-grams sorted, counts
    for lang in languages:
        grams, n = counts[lang]
        by = np.argsort(grams)
        tables[lang, order] = grams[by], n[by].astype(np.float64)
        for length in range(order - 1, 0, -1):
            longer = tables[lang, length + 1][0]
            shorter, kinds = np.unique(longer & np.uint64((1 << (16 * length)) - 1), return_counts=True)
            tables[lang, length] = shorter, kinds.astype(np.float64)  # continuation counts
    model = Model(languages, order, [], [], [], [], np.zeros(len(languages)))
    unions, probabilities = [], []
    for length in range(1, order + 1):
        union = np.unique(np.concatenate([tables[lang, length][0] for lang in languages]))
        contexts = np.unique(union >> np.uint64(16)) if length > 1 else np.zeros(1, np.uint64)
        prob = np.zeros((len(union), len(languages)))
        weight = np.ones((len(contexts), len(languages)))
        for j, lang in enumerate(languages):
            grams, n = tables[lang, length]
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            at = np.searchsorted(contexts, grams >> np.uint64(16)) if length > 1 else np.zeros(len(grams), np.int64)
            total = np.bincount(at, n, len(contexts))
            kinds = np.bincount(at, minlength=len(contexts))
            seen = total > 0
            weight[seen, j] = discount * kinds[seen] / total[seen]
            place = np.searchsorted(union, grams)
            prob[place, j] = (n - discount) / total[at]
            if length == 1:
                model.floor[j] = weight[0, j] / 65_536  # the rest is even over all symbols
        if length == 1:
            prob += model.floor[None, :]
        else:
            at = np.searchsorted(contexts, union >> np.uint64(16))
            below = np.searchsorted(unions[-1], union & np.uint64((1 << (16 * (length - 1))) - 1))
            prob += weight[at] * probabilities[-1][below]
        unions.append(union)
        probabilities.append(prob)
        for hashes, values, keys, store in ((model.grams, model.logs, union, prob), (model.contexts, model.backoff, contexts, weight)):
            own = _hash(keys, length)
            by = np.argsort(own)
            hashes.append(own[by])
            values.append(np.log(store[by]).astype(np.float32))
    model.floor = np.log(model.floor)
    return model


def log_probabilities(model: Model, packed: np.ndarray, length: int) -> np.ndarray:
    """A row of log probabilities per language for each packed n-gram, backing off where it was never seen."""
    own = _hash(packed, length)
    at = np.minimum(np.searchsorted(model.grams[length - 1], own), len(model.grams[length - 1]) - 1)
    found = model.grams[length - 1][at] == own
    out = np.empty((len(packed), len(model.languages)), np.float32)
    out[found] = model.logs[length - 1][at[found]]
    rest = packed[~found]
    if len(rest):
        if length == 1:
            out[~found] = model.floor[None, :]
        else:
            context = _hash(rest >> np.uint64(16), length)
            keys = model.contexts[length - 1]
            at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
            weight = np.where((keys[at] == context)[:, None], model.backoff[length - 1][at], 0)
            shorter = log_probabilities(model, rest & np.uint64((1 << (16 * (length - 1))) - 1), length - 1)
            out[~found] = weight + shorter
    return out


def cross_entropies(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Per text: nats per symbol under every language, and the number of letters."""
    entropies = np.zeros((len(texts), len(model.languages)))
    letters = np.zeros(len(texts), np.int64)
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (end == begin or size + len(texts[end]) <= BLOCK):
            size += len(texts[end])
            end += 1
        symbols, owner = _symbols(texts[begin:end], model.order)
        if len(symbols) >= model.order:
            packed = _ngrams(symbols, model.order)
            last, own = symbols[model.order - 1 :], owner[model.order - 1 :]
            scored = last != EDGE
            keys, inverse = np.unique(packed[scored], return_inverse=True)
            rows = log_probabilities(model, keys, model.order)
            own = own[scored]
            n = np.bincount(own, minlength=end - begin)
            for j in range(len(model.languages)):
                sums = np.bincount(own, rows[:, j][inverse], end - begin)
                entropies[begin:end, j] = -sums / np.maximum(n, 1)
            letters[begin:end] = np.bincount(own[last[scored] != GAP], minlength=end - begin)
        begin = end
    return entropies, letters


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, cross-entropy, rejected) of each text.

    score: the best language's share of a softmax over cross-entropies at the calibrated
    temperature; 0 for und.  Null and letterless texts are und and rejected.
    """
    entropies, letters = cross_entropies(model, [t or "" for t in texts])
    best = entropies.argmin(axis=1)
    lowest = entropies[np.arange(len(texts)), best]
    evidence = np.minimum(letters, 200)[:, None] / model.temperature
    score = 1 / np.exp(-np.maximum(entropies - lowest[:, None], 0) * evidence).sum(axis=1)
    none = letters == 0
    names = [UNDETERMINED if empty else model.languages[b] for b, empty in zip(best, none)]
    # short texts vary more: the allowed excess grows as their number of letters falls
    allowed = model.center[best] + (model.limit[best] - model.center[best]) * (1 + 40 / np.maximum(letters, 1))
    return names, np.where(none, 0.0, score), np.where(none, np.nan, lowest), none | (lowest > allowed)


def _sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int) -> DataFrame:
    """(lang, fold, text): about per_language rows of each language, drawn by a hash of the id; fold 0 calibrates."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}  # one row per language
    draw = F.pmod(F.xxhash64(F.lit("draw"), F.col(id_col).cast("string")), F.lit(1_000_000))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1_000_000, int(1e6 * per_language / n) + 1))]) if sizes else None
    if share is None:
        return known.select(F.col(lang_col).alias("lang"), F.lit(0).alias("fold"), F.col(text_col).alias("text"))
    return known.where(draw < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.pmod(F.xxhash64(F.lit("fold"), F.col(id_col).cast("string")), F.lit(5)).cast("int").alias("fold"), F.col(text_col).alias("text")
    )


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    order: int = ORDER,
    per_language: int = DOCS_PER_LANGUAGE,
) -> Model | None:
    """Fit models and thresholds on a sample of whole documents, about per_language of each language.

    Counting is distributed: partial counts per batch, summed by (language, n-gram).  What reaches
    the driver is the counts of the sample's distinct n-grams and, for calibration, four numbers per
    held-back document, so it does not grow with the corpus.  No labelled letters: None.
    """
    if not 2 <= order <= 4:
        raise ValueError("n-grams of 2 to 4 characters fit a 64-bit key")
    small_batches(docs.sparkSession)
    sample = _sample(docs, id_col, text_col, lang_col, per_language)

    def count(batches):
        for pdf in batches:
            for lang, group in pdf.groupby("lang"):
                symbols, _ = _symbols(group["text"].tolist(), order)
                packed = _ngrams(symbols, order)
                keys, n = np.unique(packed[symbols[order - 1 :] != EDGE], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "n": n})

    summed = sample.where("fold != 0").mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    found = summed.toPandas()
    counts = {}
    for lang, group in found.groupby("lang"):
        grams = group["gram"].to_numpy(np.int64).view(np.uint64)
        if ((grams & np.uint64(0xFFFF)) != GAP).any():
            counts[str(lang)] = grams, group["n"].to_numpy()
    if not counts:
        return None
    model = fit_counts(counts, order)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def measure(batches):
        for pdf in batches:
            model = shared.value
            entropies, letters = cross_entropies(model, pdf["text"].tolist())
            known = pdf["lang"].isin(model.languages).to_numpy() & (letters > 0)
            own = np.array([model.languages.index(x) if k else 0 for x, k in zip(pdf["lang"], known)], np.int64)
            right = entropies[np.arange(len(own)), own]
            rest = entropies.copy()
            rest[np.arange(len(own)), own] = np.inf
            frame = pd.DataFrame({"lang": pdf["lang"], "letters": letters, "own": right, "gap": np.minimum(rest.min(axis=1) - right, 100.0)})
            yield frame[known]

    held = sample.where("fold = 0").mapInPandas(measure, "lang string, letters long, own double, gap double").toPandas()
    return _calibrate(model, held)


def _calibrate(model: Model, held: pd.DataFrame) -> Model:
    """Thresholds and temperature from held-back documents."""
    long_enough = held[held["letters"] >= 100]
    every = long_enough["own"].to_numpy()
    typical = float(np.median(every)) if len(every) else 3.0
    apart = np.abs(long_enough["own"] - long_enough.groupby("lang")["own"].transform("median")).to_numpy()
    centers, limits = [], []
    for lang in model.languages:
        own = long_enough.loc[long_enough["lang"] == lang, "own"].to_numpy()
        center = float(np.median(own)) if len(own) else typical
        away = np.abs(own - center)
        if len(own) < FEW_HELD:  # too few to say: as the languages together, but no stricter than its own
            center, away = max(center, typical), apart
        spread = float(np.median(away)) if len(away) else 0.0
        centers.append(center)
        # medians, which documents with a wrong label cannot move as they move the worst
        limits.append(center + SPREADS * max(spread, LEAST_SPREAD * center))
    model.center, model.limit = np.array(centers), np.array(limits)
    best = None
    for temperature in (0.5, 1, 2, 5, 10, 20, 50, 100):
        evidence = np.minimum(held["letters"], 200) / temperature
        loss = float(np.logaddexp(0, -held["gap"] * evidence).mean()) if len(held) else 0.0
        if best is None or loss < best:
            best, model.temperature = loss, float(temperature)
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] = ()) -> DataFrame:
    """One row per input row: (id_col, *keep, lang_pred, score, cross_entropy, rejected).

    Null, empty and letterless texts: und, score 0, rejected.  Without a model every text is und.
    Rows that repeat come back as often as they came; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), *keep, F.col(text_col).alias("__text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = (("lang_pred", T.StringType()), ("score", T.DoubleType()), ("cross_entropy", T.DoubleType()), ("rejected", T.BooleanType()))
    schema = T.StructType(rows.schema.fields[:-1] + [T.StructField(*f) for f in added])

    def run(batches):
        for batch in slices(batches):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            model = shared.value
            if model is None:
                n = len(texts)
                found = [UNDETERMINED] * n, np.zeros(n), np.full(n, np.nan), np.ones(n, bool)
            else:
                found = classify(model, texts)
            arrays = [pa.array(found[0], pa.string()), *[pa.array(x) for x in found[1:]]]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + arrays, names=schema.names)

    return rows.mapInArrow(run, schema)


def accepted(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text is not rejected; null, letterless and foreign texts go, without a model all."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            model = shared.value
            if model is not None:
                yield batch.filter(pa.array(~classify(model, batch.column(place).to_pylist())[3]))

    # numbered names, because any name may come
    rows = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)
