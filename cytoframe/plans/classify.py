"""The classifier comparison: split, scale, fit a grid per probe and feature set, report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions.names import classifier_family
from cytoframe.operators.columns import quoted
from cytoframe.operators.classifiers import compared
from cytoframe.operators.models import add_annotator
from cytoframe.operators.resample import stratified_split
from cytoframe.operators.stats import confusion_report, z_scores
from cytoframe.session import materialise


def prepared_splits(
    df: DataFrame, features: Sequence[str], y: str, key: str,
    probe: str | None = None, probe_features: Sequence[str] = (), test_size: float = 0.25,
    seed: int = 0,
) -> dict[str, DataFrame]:
    """Stratified train and test rows, scaled by the training parameters."""
    parted = materialise(stratified_split(df, y, key, test_size, seed))
    splits = {
        s: parted.where(F.col("split") == s).drop("split") for s in ("train", "test")
    }
    scaled, _ = z_scores(splits, list(features), probe_features, probe)
    return scaled


def predictions(
    splits: Mapping[str, DataFrame], sets: Mapping[str, Sequence[str]], y: str, key: str,
    grid: Sequence[dict], probe: str | None = None, seed: int = 0,
    annotator: tuple[str, str] | None = None,
) -> DataFrame:
    """Long predictions (split, probe, features, classifier, key, true, pred).

    All probes and feature sets are fitted together. ``annotator`` = (name, score column)
    adds a person as one more classifier.
    """
    made = compared(splits, sets, y, key, grid, probe, seed)
    if annotator:
        for s, df in splits.items():
            tagged = df.withColumns({"split": F.lit(s), "probe": quoted(probe).cast("string") if probe else F.lit("all")})
            tagged = tagged.withColumn("features", F.explode(F.array(*[F.lit(n) for n, columns in sets.items() if columns])))
            made = add_annotator(made, tagged, y, annotator[1], key, annotator[0])
    return made


def report(predicted: DataFrame) -> DataFrame:
    """Macro and weighted measures per split, probe, feature set and classifier."""
    made = confusion_report(predicted, ["split", "probe", "features", "classifier"])
    return made.withColumn("Classifier type", classifier_family("classifier"))
