"""Feature table to the analysis tables: clean, reduce, join, model, tidy, collate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoframe.functions import names as N
from cytoframe.functions import scalars as S
from cytoframe.functions.paths import posix
from cytoframe.operators.columns import (
    drop_containing,
    drop_existing,
    existing,
    keep_existing,
    quoted,
    rename_existing,
    rename_substrings,
    require_integers,
)
from cytoframe.operators.joins import merge
from cytoframe.operators.models import Ridge, fit_ridge
from cytoframe.operators.quality import (
    check,
    drop_low_variance,
    drop_scored,
    duplicate_keys,
    known_value,
    non_null_total,
    prune_iteratively,
)
from cytoframe.operators.reshape import (
    stack,
    stack_like_first,
    tidy,
    unexpected_values,
    widen,
    widen_from_data,
)
from cytoframe.operators.stats import (
    apply_scaler,
    global_median,
    over_group_median,
    scaler_params,
)
from cytoframe.session import stored

# fixed values: probes with their amplifier, in column order
PROBES = [
    "HPRT1-B1", "COL2A1-B4", "H19-B3", "ATP2A2-B1", "MYH6-B1", "MYH7-B4", "BAG3-B4", "TCAP-B3",
]
GENES = [N.without_amplifier(p) for p in PROBES]

# fixed values: metadata columns of the feature table
OBS_COLUMNS = [
    "ImageNumber", "ImagePath", "ImageFailed", "FOVId", "cell_border",
    "napariCell_ObjectNumber", "rescaled_2D_single_cell_tiff_path", "fov_path",
    "well_position", "microscope", "image_date", "probe488", "probe546", "probe647",
    "plate_name", "cell_line", "cell_age", "napariCell_nuclei_Count", "finalnuc_border",
    "finalnuc_ObjectNumber", "finalnuc_Parent_FilterNuc", "nuccentroid_ObjectNumber",
    "mh_structure_org_score", "kg_structure_org_score", "probe_561_loc_score",
    "probe_638_loc_score",
]
# fixed values: columns of the small table
SMALL_OBS = [
    "cell_age", "napariCell_nuclei_Count", "finalnuc_border", "mh_structure_org_score",
    "kg_structure_org_score", "napariCell_ObjectNumber", "fov_path", "probe546", "probe647",
    "probe_561_loc_score", "probe_638_loc_score", "rescaled_2D_single_cell_tiff_path",
]
SMALL_FEATURES = [
    "napariCell_AreaShape_Area", "napariCell_AreaShape_MajorAxisLength",
    "napariCell_AreaShape_MinorAxisLength", "napariCell_Children_seg_probe_561_Count",
    "napariCell_Children_seg_probe_638_Count",
]
# fixed values: global structure columns
STRUCTURE_COLUMNS = [
    "napariCell_ObjectNumber", "original_fov_location", "Frac_Area_Background",
    "Frac_Area_DiffuseOthers", "Frac_Area_Fibers", "Frac_Area_Disorganized_Puncta",
    "Frac_Area_Organized_Puncta", "Frac_Area_Organized_ZDisks",
    "Maximum_Coefficient_Variation", "Peak_Height", "Peak_Distance", "Peak_Angle",
    "IntensityMedian", "IntensityIntegrated", "IntensityMedianBkgSub",
    "IntensityIntegratedBkgSub",
]
# fixed values: feature names to short names
SHORT_NAMES = {
    "napariCell_nuclei_Count": "nuclei_count",
    "consensus_structure_org_score": "structure_org_score",
    "napariCell_AreaShape_Area": "cell_area",
    "napariCell_AreaShape_AspectRatio": "cell_aspect_ratio",
    "Frac_Area_Background": "frac_area_background",
    "Frac_Area_DiffuseOthers": "frac_area_messy",
    "Frac_Area_Fibers": "frac_area_threads",
    "Frac_Area_Disorganized_Puncta": "frac_area_random",
    "Frac_Area_Organized_Puncta": "frac_area_regular_dots",
    "Frac_Area_Organized_ZDisks": "frac_area_regular_stripes",
    "Maximum_Coefficient_Variation": "max_coeff_var",
    "Peak_Height": "h_peak",
    "Peak_Distance": "peak_distance",
    "Peak_Angle": "peak_angle",
}
# fixed values: features of the organisation score
SCORE_FEATURES = [
    "cell_area", "cell_aspect_ratio", "frac_area_background", "frac_area_messy",
    "frac_area_threads", "frac_area_random", "frac_area_regular_dots",
    "frac_area_regular_stripes", "max_coeff_var", "h_peak", "peak_distance",
]
# fixed values: class number to class name in the probe-by-class table
CLASS_PARTS = {
    "class_0": "background", "class_1": "messy", "class_2": "threads",
    "class_3": "random_dots", "class_4": "regular_dots", "class_5": "regular_stripes",
}
# fixed values: localisation marks to names
LOCALISATION = {
    "n": "Low expression", "0": "Non-sarcomeric", "1": "Sarcomeric", "2": "Sarcomeric",
    "3": "Sarcomeric",
}
# fixed values: published column names
EXPERT = "Expert structural annotation score"
PRETTY_NAMES = {
    "cell_age": "Cell age",
    "nuclei_count": "Nuclei count",
    "finalnuc_border": "Nucleus touches FOV border",
    "mh_structure_org_score": f"{EXPERT} (annotator 1)",
    "kg_structure_org_score": f"{EXPERT} (annotator 2)",
    "napariCell_ObjectNumber": "Cell number",
    "fov_path": "FOV path",
    "rescaled_2D_single_cell_tiff_path": "Rescaled 2D single cell tiff path",
    "structure_org_score": f"{EXPERT} (mean)",
    "cell_area_micrometers_squared": "Cell area (μm^2)",
    "cell_aspect_ratio": "Cell aspect ratio",
    "frac_area_background": "Fraction cell area background",
    "frac_area_messy": "Fraction cell area diffuse/other",
    "frac_area_threads": "Fraction cell area fibers",
    "frac_area_random": "Fraction cell area disorganized puncta",
    "frac_area_regular_dots": "Fraction cell area organized puncta",
    "frac_area_regular_stripes": "Fraction cell area organized z-disks",
    "max_coeff_var": "Max coefficient var",
    "h_peak": "Peak height",
    "peak_distance_micrometers": "Peak distance (μm)",
    "peak_angle": "Peak angle",
    "IntensityMedian": "Alpha-actinin intensity (median)",
    "IntensityMedianNoUnits": "Alpha-actinin intensity (median, normalized per day)",
    "IntensityIntegrated": "Alpha-actinin intensity (integrated)",
    "consensus_structure_org_score_roundup": f"{EXPERT} (round-up)",
    "consensus_structure_org_score_grouped": f"{EXPERT} (grouped)",
    "structure_org_weighted_linear_model_all": "Combined organizational score",
    "structure_org_weighted_linear_model_all_rounded": "Combined organizational score (rounded)",
    "MYH7-MYH6_normalized_difference": "MYH7-MYH6 relative transcript abundance (normalized)",
    **{f"{g}_localization": f"{g} localization" for g in ("MYH6", "MYH7")},
    **{
        f"{g}_probe_frac_{part}_gain_over_random":
            f"Enrichment of {g} transcript localization to {text}"
        for g in ("MYH6", "MYH7")
        for part, text in (
            ("regular_dots", "organized puncta"),
            ("regular_stripes", "organized z-disks"),
            ("threads", "fibers"),
            ("threads_regular_dots_regular_stripes",
             "fibers, organized puncta, and organized z-disks"),
        )
    },
    **{
        f"{g}_dist_to_alpha-actinin_segmentation":
            f"{g} probe distance to alpha-actinin segmentation (mean)"
        for g in ("MYH6", "MYH7")
    },
}


# ---------------------------------------------------------------- cleaning

def split_columns(
    df: DataFrame, obs_columns: Sequence[str] = OBS_COLUMNS
) -> tuple[list[str], list[str]]:
    """Metadata and feature columns; together they must be all columns of the table."""
    obs = existing(df, obs_columns)
    features = [
        c for c in df.columns if c.startswith(tuple(N.REGION_PREFIXES)) and c not in obs
    ]
    left = [c for c in df.columns if c not in obs and c not in features]
    if left:
        raise ValueError(f"neither metadata nor feature: {left}")
    return obs, features


def clean_features(
    df: DataFrame, obs_columns: Sequence[str] = OBS_COLUMNS,
    threshs: Sequence[float] = (0.1, 0.01), exclude_scores: Sequence[int] = (-1, 0),
    probes: Sequence[str] = ("probe546", "probe647"),
) -> tuple[DataFrame, list[str]]:
    """Prune sparse columns and rows, drop bad scores, positions and flat features.

    Deciding which columns stay needs one aggregate job per threshold and one for the
    variances. Column annotations are computed in Spark from the column names.
    """
    _, features = split_columns(df, obs_columns)
    df, features = prune_iteratively(df, features, threshs)
    df = drop_scored(df, ["mh_structure_org_score", "kg_structure_org_score"], exclude_scores)
    kinds = N.feature_dimension(df.sparkSession, features)
    located = {r["name"] for r in kinds.where(F.col("type") == "location").collect()}
    df, features = df.drop(*located), [f for f in features if f not in located]
    return drop_low_variance(df, probes, features)


def annotation_checks(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Every feature needs a region, channel and type; FISH features a wavelength."""
    var = N.feature_dimension(df.sparkSession, list(features))
    rows = [
        check(f"{c} known", var, F.count_if(F.col(c).isNull()), 0)
        for c in ("region", "channel", "type")
    ]
    rows.append(
        check("wavelength of FISH", var, F.count("probe_wavelength"),
              F.count_if(F.col("channel") == "FISH"))
    )
    return stack(rows)


def pretty_names(genes: Sequence[str]) -> dict[str, str]:
    """Published column names of a table with these genes."""
    counts = {f"{g}_count": f"{g} count" for g in genes}
    return PRETTY_NAMES | counts | {f"{g}_count_per_micrometer_squared": f"{g} (count/μm^2)" for g in genes}


def cell_checks(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], known: Mapping[str, Sequence[str]]
) -> DataFrame:
    """Checks of the rows: every cell is named once, columns hold known names only, and every feature is measured in every cell."""
    named = df.groupBy(*[quoted(k) for k in keys]).agg(F.count("*").alias("__n__"))
    listed = reduce(lambda a, b: a & b, [F.coalesce(quoted(c).isin(*names), F.lit(False)) for c, names in known.items()])
    return stack([
        check("cells named once", named, F.count("*"), F.coalesce(F.sum("__n__"), F.lit(0))),
        check("probes known", df, F.count_if(listed), F.count("*")),
        check("features measured", df, non_null_total(features), F.count("*") * len(features)),
    ])


def small_table(df: DataFrame) -> DataFrame:
    """A handful of features with aspect ratio and mean expert score."""
    chosen = keep_existing(df, [*SMALL_OBS, *SMALL_FEATURES])
    made = chosen.withColumns(
        {
            "napariCell_AreaShape_AspectRatio": S.ratio(
                "napariCell_AreaShape_MinorAxisLength", "napariCell_AreaShape_MajorAxisLength"
            ),
            "consensus_structure_org_score": S.mean_or_null(
                "kg_structure_org_score", "mh_structure_org_score"
            ),
        }
    ).drop("napariCell_AreaShape_MajorAxisLength", "napariCell_AreaShape_MinorAxisLength")
    return made.withColumnsRenamed({"probe546": "probe_561", "probe647": "probe_638"})


def structure_table(df: DataFrame) -> DataFrame:
    chosen = rename_existing(keep_existing(df, STRUCTURE_COLUMNS), SHORT_NAMES)
    return chosen.withColumnRenamed("original_fov_location", "fov_path").withColumn(
        "fov_path", posix("fov_path")
    )


def add_organisation_score(
    df: DataFrame, features: Sequence[str] = SCORE_FEATURES, y: str = "structure_org_score",
    out: str = "structure_org_weighted_linear_model_all",
) -> tuple[DataFrame, Ridge]:
    """Standardise, fit the weighted ridge and predict every row."""
    params = scaler_params(df, list(features))
    scaled = apply_scaler(df.withColumns({f"__s_{f}": quoted(f) for f in features}),
                          _renamed_params(params, features), [f"__s_{f}" for f in features])
    model = fit_ridge(scaled, [f"__s_{f}" for f in features], y)
    predicted = model.predict(scaled, out).drop(*[f"__s_{f}" for f in features])
    return predicted, Ridge(tuple(features), model.coefficients, model.intercept)


def _renamed_params(params: DataFrame, features: Sequence[str]) -> DataFrame:
    return params.withColumnsRenamed(
        {f"__{k}_{f}": f"__{k}___s_{f}" for f in features for k in ("mean", "sd")}
    )


def analysis_tables(
    features: DataFrame, structure: DataFrame, probes: Sequence[str] = PROBES
) -> tuple[DataFrame, DataFrame, Ridge]:
    """Wide table, tidy table (one row per cell and probe) and the fitted model.

    ``features`` is the cleaned feature table.
    """
    small = merge(small_table(features), structure_table(structure))
    pairs = [
        ("probe_561", "napariCell_Children_seg_probe_561_Count"),
        ("probe_638", "napariCell_Children_seg_probe_638_Count"),
    ]
    wide = widen(small, pairs, probes)
    wide = wide.withColumns(
        {
            "consensus_structure_org_score_roundup": S.round_up("consensus_structure_org_score"),
            "consensus_structure_org_score_grouped": S.grouped_score(
                "consensus_structure_org_score"
            ),
        }
    )
    # the fit reads the table several times, so the join above is written once
    wide = stored(rename_existing(wide, SHORT_NAMES))
    wide, model = add_organisation_score(wide)
    long = tidy(wide, [f"{p}_count" for p in probes])
    wide = wide.toDF(*[N.without_amplifier(c) for c in wide.columns])
    long = long.withColumn("FISH_probe", N.probe_base_name("FISH_probe")).withColumn(
        "FISH_probe_density", S.ratio("FISH_probe_count", "cell_area")
    )
    genes = [N.without_amplifier(p) for p in probes]
    wide = wide.withColumns(
        {f"{g}_density": S.ratio(f"{g}_count", "cell_area") for g in genes}
    )
    return wide, long, model


def collated(
    wide: DataFrame,
    features: DataFrame,
    probe_metrics: DataFrame,
    probe_classes: DataFrame,
    pixel_size: float = 0.12,
    genes: Sequence[str] = GENES,
) -> DataFrame:
    """The published plot table: enrichments, relative abundance, units, pretty names."""
    cell = ["fov_path", "napariCell_ObjectNumber"]
    key = features.select(
        *cell,
        N.probe_base_name("probe546").alias("probe_561"),
        N.probe_base_name("probe647").alias("probe_638"),
        "probe_561_loc_score", "probe_638_loc_score",
    )
    metrics = rename_existing(probe_metrics, {"original_fov_location": "fov_path"}).select(
        *cell, "seg_561_cell_abs_dist_struc_total_mean", "seg_638_cell_abs_dist_struc_total_mean"
    )
    classes = rename_substrings(
        rename_existing(probe_classes, {"original_fov_location": "fov_path"}), CLASS_PARTS
    )
    pair = merge(merge(wide, key), metrics).dropna("any", subset=["MYH6_density", "MYH7_density"])
    pair = drop_containing(merge(pair, classes, cell), "OUTSIDE")
    groups = {f: [f] for f in ("threads", "regular_dots", "regular_stripes")}
    groups["threads_regular_dots_regular_stripes"] = list(groups)
    made = {}
    for seg, gene in (("seg_561", "MYH6"), ("seg_638", "MYH7")):
        for name, parts in groups.items():
            made[f"{gene}_probe_frac_{name}_gain_over_random"] = S.enrichment(
                [f"{seg}_probe_px_{p}" for p in parts],
                f"{seg}_total_probe_cyto", f"{seg}_probe_px_nuc",
                [f"frac_area_{p}" for p in parts],
            )
        made[f"{gene}_dist_to_alpha-actinin_segmentation"] = quoted(
            f"{seg}_cell_abs_dist_struc_total_mean"
        )
    made["MYH7-MYH6_normalized_difference"] = S.relative_difference(
        "MYH7_density", "MYH6_density",
        F.lit(global_median(wide, "MYH7_density")), F.lit(global_median(wide, "MYH6_density")),
    )
    for gene, mark in (("MYH6", "probe_561_loc_score"), ("MYH7", "probe_638_loc_score")):
        # an unknown mark stops the job instead of turning into a missing value
        made[f"{gene}_localization"] = known_value(mark, list(LOCALISATION), S.recode(mark, LOCALISATION))
    special = pair.select(
        "napariCell_ObjectNumber", "fov_path", *[e.alias(n) for n, e in made.items()]
    )
    out = wide.withColumns(
        {
            **{
                f"{g}_count_per_micrometer_squared": S.density_units(f"{g}_density", pixel_size)
                for g in genes
            },
            "cell_area_micrometers_squared": S.area_units("cell_area", pixel_size),
            "peak_distance_micrometers": S.length_units("peak_distance", pixel_size),
            "structure_org_weighted_linear_model_all_rounded": S.rounded_score(
                "structure_org_weighted_linear_model_all"
            ),
        }
    )
    out = over_group_median(out, ["cell_age"], "IntensityMedian", "IntensityMedianNoUnits")
    out = merge(out, special, None, "left")
    out = drop_existing(
        out,
        ["IntensityMedianBkgSub", "IntensityIntegratedBkgSub", "cell_area", "peak_distance",
         *[f"{g}_density" for g in genes]],
    )
    return require_integers(
        rename_existing(out, pretty_names(genes)),
        ["Nuclei count", f"{EXPERT} (annotator 1)", f"{EXPERT} (annotator 2)", "Cell number",
         f"{EXPERT} (round-up)"],
    )


def localisation_check(features: DataFrame) -> DataFrame:
    """Localisation marks outside the known ones (must be empty)."""
    return unexpected_values(
        features, ["probe_561_loc_score", "probe_638_loc_score"], list(LOCALISATION)
    )


# ---------------------------------------------------------------- second collation

# fixed values: live-cell column names to feature table names
LIVE_NAMES = {
    "diffuse_fraction_area_covered": "Frac_Area_DiffuseOthers",
    "fibers_fraction_area_covered": "Frac_Area_Fibers",
    "disorganized_puncta_fraction_area_covered": "Frac_Area_Disorganized_Puncta",
    "organized_puncta_fraction_area_covered": "Frac_Area_Organized_Puncta",
    "organized_z_disk_fraction_area_covered": "Frac_Area_Organized_ZDisks",
    "Aspect_Ratio": "Cell aspect ratio",
    "Area": "napariCell_AreaShape_Area",
    "MH_score": "mh_structure_org_score",
    "KG_score": "kg_structure_org_score",
    "Cell age": "cell_age",
    "FOV": "fov_path",
    "cell_id": "napariCell_ObjectNumber",
    "full_cell_total_sum_intensity": "alpha-actinin protein intensity (sum)",
    "full_cell_total_sum_intensity_bg_subtracted":
        "alpha-actinin protein intensity (sum, background subtracted)",
}
# fixed values: feature table names to published names
REVISED_NAMES = {
    "napariCell_AreaShape_Area": "Cell area (μm^2)",
    "Frac_Area_Background": "Fraction cell area background",
    "Frac_Area_DiffuseOthers": "Fraction cell area diffuse/other",
    "Frac_Area_Fibers": "Fraction cell area fibers",
    "Frac_Area_Disorganized_Puncta": "Fraction cell area disorganized puncta",
    "Frac_Area_Organized_Puncta": "Fraction cell area organized puncta",
    "Frac_Area_Organized_ZDisks": "Fraction cell area organized z-disks",
    "Maximum_Coefficient_Variation": "Max coefficient var",
    "Peak_Height": "Peak height",
    "Peak_Distance": "Peak distance (μm)",
    "cell_age": "Cell age",
}
# fixed values
REVISED_FEATURES = [
    "napariCell_AreaShape_Area", "Cell aspect ratio", "Frac_Area_Background",
    "Frac_Area_DiffuseOthers", "Frac_Area_Fibers", "Frac_Area_Disorganized_Puncta",
    "Frac_Area_Organized_Puncta", "Frac_Area_Organized_ZDisks",
    "Maximum_Coefficient_Variation", "Peak_Height", "Peak_Distance",
]
# fixed values
REVISED_METADATA = [
    "Dataset", "napariCell_ObjectNumber", "fov_path", "cell_age", "replate_date", "image_date",
    "plate_name", "well_position", "ge_wellID", "mh_structure_org_score",
    "kg_structure_org_score", "no_structure", "gfp_keep", "Type", "probe546", "probe647",
    "napariCell_Children_seg_probe_561_Count", "napariCell_Children_seg_probe_638_Count",
]
# fixed values
AGE_GROUPS = {18: 18, 19: 18, 25: 25, 26: 25, 32: 32, 33: 32}
BACKGROUND_SUBTRACTED = "alpha-actinin protein intensity (sum, background subtracted)"


def revised_fish(
    scored: DataFrame, marked: Sequence[DataFrame], plates: DataFrame,
    structure: Sequence[DataFrame],
) -> DataFrame:
    """Fixed cells of all data sets with plate dates, classifier scores and keep flag.

    ``scored`` has expert scores (keep = both positive); the ``marked`` sets carry a
    no-structure mark instead (keep = unmarked).
    """
    frames = [scored.withColumn(
        "gfp_keep", S.keep_both_positive("kg_structure_org_score", "mh_structure_org_score")
    )]
    frames += [m.withColumn("gfp_keep", S.keep_unmarked("no_structure")) for m in marked]
    cells = stack(frames).withColumns(
        {
            "napariCell_ObjectNumber": F.col("napariCell_ObjectNumber").cast("int").cast("string"),
            "Type": F.lit("FISH"),
        }
    )
    dated = plates.select(
        F.col("`Plate Name`").cast("long").alias("plate_name"),
        F.col("`Replate Date`").alias("replate_date"), "Dataset",
    )
    cells = merge(cells, dated, ["plate_name"]).withColumn(
        "ge_wellID", N.well_id("plate_name", "well_position")
    )
    scores = drop_existing(stack(list(structure)), ["Age", "Dataset"])
    scores = rename_existing(scores, {"original_fov_location": "fov_path"}).withColumn(
        "napariCell_ObjectNumber", F.col("napariCell_ObjectNumber").cast("int").cast("string")
    )
    joined = merge(cells, scores, ["napariCell_ObjectNumber", "fov_path"]).withColumns(
        {
            "Cell aspect ratio": S.ratio(
                "napariCell_AreaShape_MinorAxisLength", "napariCell_AreaShape_MajorAxisLength"
            ),
            "probe546": N.probe_base_name("probe546"),
            "probe647": N.probe_base_name("probe647"),
        }
    )
    joined = rename_existing(
        joined,
        {"IntensitySumIntegrated": "alpha-actinin protein intensity (sum)",
         "IntensitySumIntegratedBkgSub": BACKGROUND_SUBTRACTED},
    )
    return keep_existing(
        joined,
        [*REVISED_METADATA, "alpha-actinin protein intensity (sum)", BACKGROUND_SUBTRACTED,
         *REVISED_FEATURES],
    )


def revised_live(live: DataFrame, features: Sequence[str] = REVISED_FEATURES,
                 cutoff: float = 1080.0) -> DataFrame:
    """Live cells in the same columns; kept when their protein density reaches the cut-off."""
    df = rename_existing(live, LIVE_NAMES)
    df = df.fillna(0, existing(df, features))
    return df.withColumns(
        {
            "ge_wellID": N.well_id("plate_name", "well_position"),
            "Dataset": F.lit("Live"),
            "Type": F.lit("Live"),
            "napariCell_ObjectNumber": F.col("napariCell_ObjectNumber").cast("string"),
            "gfp_keep": S.keep_dense(BACKGROUND_SUBTRACTED, "napariCell_AreaShape_Area", cutoff),
        }
    )


def revised_table(
    fish: DataFrame, live: DataFrame, pixel_size: float = 0.12, train_on: str = "OldFish"
) -> DataFrame:
    """Both kinds of cells with densities in real units and the organisation score.

    The model is fitted on one data set (cells with positive scores) and applied to all.
    """
    pairs = [
        ("probe546", "napariCell_Children_seg_probe_561_Count"),
        ("probe647", "napariCell_Children_seg_probe_638_Count"),
    ]
    # the names, the check of repeated cells and the fit read both tables several times
    fish, live = stored(fish), stored(live)
    wide = widen_from_data(fish, pairs)
    counts = [c for c in wide.columns if c.endswith("_count")]
    wide = wide.withColumns(
        {c[: -len("_count")] + "_density": S.ratio(c, "napariCell_AreaShape_Area") for c in counts}
    )
    both = stack_like_first(wide, live)
    densities = [c for c in both.columns if c.endswith("_density")]
    both = both.withColumns(
        {
            "napariCell_AreaShape_Area": S.area_units("napariCell_AreaShape_Area", pixel_size),
            "Peak_Distance": S.length_units("Peak_Distance", pixel_size),
            **{c: S.density_units(c, pixel_size) for c in densities},
        }
    )
    both = rename_existing(
        both,
        {**REVISED_NAMES,
         **{c: c.split("_")[0] + " (count/μm^2)" for c in densities}},
    ).withColumns(
        {
            f"{EXPERT} (mean)": S.mean_of_present(
                "mh_structure_org_score", "kg_structure_org_score"
            ),
            "Cell age": S.recode("Cell age", AGE_GROUPS),
        }
    )
    cell = [REVISED_NAMES.get(c, c) for c in ("fov_path", "napariCell_ObjectNumber")]
    if duplicate_keys(both.where(F.col("Dataset").isNotNull()), ["Dataset", *cell]).take(1):
        raise ValueError("a cell occurs more than once in a data set")
    features = [REVISED_NAMES.get(f, f) for f in REVISED_FEATURES]
    train = both.where(
        (F.col("Dataset") == train_on)
        & S.keep_both_positive("kg_structure_org_score", "mh_structure_org_score")
    )
    # scaled copies live beside the published columns
    copies = {f"__f{i}": quoted(f) for i, f in enumerate(features)}
    params = scaler_params(train.withColumns(copies), list(copies))
    model = fit_ridge(
        apply_scaler(train.withColumns(copies), params, list(copies)), list(copies),
        f"{EXPERT} (mean)",
    )
    scaled = apply_scaler(both.withColumns(copies), params, list(copies))
    return model.predict(scaled, "Combined organizational score").drop(*copies)


def widening_check(before: DataFrame, after: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """Probe names present before widening against counts present after."""
    counts = [c for c in after.columns if c.endswith("_count")]
    names = before.agg(non_null_total(id_columns).alias("n")).first()["n"]
    return check("probe counts kept", after, non_null_total(counts), names)

