"""From images to predictions: encode, lay out, build detectors, embed, and classify; all images at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codelattice.functions.display import label_text
from codelattice.functions.similarity import similarity
from codelattice.operators import activation as A
from codelattice.operators import decode as D
from codelattice.operators import energy as N
from codelattice.operators import features
from codelattice.operators.encoder import DEFAULT, Encoder
from codelattice.operators.spatial import coverage
from codelattice.plans import layout as L
from codelattice.plans.tuner import tuned
from codelattice.tables import ordered_index, stored

#: Thresholds of the pipeline from gradients to votes.
GRADIENT, ACTIVATION, ENERGY, LEVEL, SATURATION, ENERGY_RADIUS = 0.05, 0.6, 0.12, 0.45, 260, 3
LAMBDAS, MAX_DETECTORS = (0.45, 0.55, 0.65, 0.75, 0.85), 2_048
CLASSES = tuple(range(10))


def encode_images(images: DataFrame, encoder: Encoder = DEFAULT, threshold: float = GRADIENT) -> DataFrame:
    """(image_id, label, seq, hue, bits, ones): a code for every patch with a gradient; the hue is its angle."""
    rows = features.measurements(images, threshold)
    bits = encoder.encode(F.col("angle"), F.col("x"), F.col("y"))
    return rows.select("image_id", "label", "seq", F.col("angle").alias("hue"), bits.alias("bits")).withColumn("ones", F.size("bits"))


def layout_points(codes: DataFrame) -> DataFrame:
    """(point_id, label, hue, ones, bits): codes grouped by hue in the order of the groups' first codes."""
    first = Window.partitionBy("hue")
    rows = codes.withColumn("lead", F.min(F.struct("image_id", "seq")).over(first))
    indexed = ordered_index(rows, [F.col("lead").asc(), F.col("image_id").asc(), F.col("seq").asc()], "point_id")
    return indexed.select("point_id", label_text(F.col("hue")).alias("label"), "hue", "ones", "bits")


def tuned_phases(points: DataFrame) -> list[L.Phase]:
    """A long phase, then a short one, sized by the number of points."""
    n = points.count()
    values = points.sparkSession.range(1).select(*[c.alias(k) for k, c in tuned(F.lit(n)).items()]).first()
    adaptive = L.Adaptive(start=max(1, values["grid"] // 2))
    return [
        L.Phase("long", values["long_steps"], values["long_pairs"], refresh=values["long_refresh"], energy_every=200),
        L.Phase("short", values["short_steps"], values["short_pairs"], values["local_radius"], adaptive, cutoff=0.65, weighted=True, tiles=8, energy_every=200),
    ]


@dataclass
class Recogniser:
    """A layout with its energies, detectors and their coverage, as stored tables."""

    points: DataFrame
    energies: DataFrame
    detectors: DataFrame
    covered: DataFrame
    encoder: Encoder

    @classmethod
    def over(cls, placed: DataFrame, encoder: Encoder = DEFAULT, similarity_name: str = "cosine", level: float = 0.65, eta: float | None = 0.0) -> Recogniser:
        """From placed points (point_id, y, x, bits); a layout without a single useful detector is an error."""
        placed = stored(placed.select("point_id", "y", "x", "bits"), "points")
        raw = N.local_energy(placed, encoder.code_length, ENERGY_RADIUS, similarity_name, level, eta)
        energies = stored(N.normalised_energy(raw), "energies")
        detectors = stored(A.build_detectors(placed, energies, LAMBDAS, MAX_DETECTORS), "detectors")
        if not detectors.limit(1).count():
            raise ValueError("the layout has no detector")
        return cls(placed, energies, detectors, stored(coverage(detectors, placed, 6), "coverage"), encoder)

    def embed(self, codes: DataFrame, images: DataFrame) -> DataFrame:
        """(image_id, label, bits, ones) of every image; images without a code or an active detector have no bits."""
        values = A.activate(codes.select("image_id", F.col("seq").alias("stim"), "bits"), self.points, "cosine", ACTIVATION, None)
        levels = A.detector_levels(values, self.energies, self.detectors, self.covered, ENERGY, LEVEL)
        found = A.embed_single_bits(levels, self.detectors, SATURATION)
        rows = images.select("image_id", "label").join(found, "image_id", "left")
        return rows.select("image_id", "label", F.coalesce("bits", F.array().cast("array<int>")).alias("bits")).withColumn("ones", F.size("bits"))


def classify(queries: DataFrame, memory: DataFrame, temperature: float = 0.35, k_total: int = 200, k_per_class: int = 20, name: str = "jaccard2", classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """(query_id, predicted_class, probabilities, confidence) of embeddings (query_id, bits) by a memory (memory_id, label, bits).

    Embeddings are sparse, so candidates come from an inverted index; memory rows of other classes
    do not vote, and queries without bits or neighbours get even probabilities.
    """
    q = queries.select("query_id", F.size("bits").alias("ones_q"), F.explode("bits").alias("bit"))
    m = memory.where(F.col("label").isin(*classes)).select("memory_id", "label", F.size("bits").alias("ones_m"), F.explode("bits").alias("bit"))
    met = q.join(m, "bit").groupBy("query_id", "memory_id", "label", "ones_q", "ones_m").agg(F.count("*").alias("common"))
    found = met.select("query_id", "memory_id", "label", similarity(name, F.col("common"), F.col("ones_q"), F.col("ones_m")).alias("sim"))
    votes = D.soft_vote(D.nearest(found, k_total, k_per_class), temperature)
    return D.predictions(queries, votes, list(classes))


def evaluate(predicted: DataFrame, queries: DataFrame) -> float:
    """The share of queries whose predicted class is their label; 0 of none."""
    row = D.accuracy(predicted, queries).first()
    return row["accuracy"] if row and row["n"] else 0.0
