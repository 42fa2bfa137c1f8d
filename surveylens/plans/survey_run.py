"""The end-to-end survey run: five-frame cleaning bundle, summary tables, publish.

    bundle = clean_survey(raw, as_of_year=2025, iso_dim=iso)
    tables = core_tables(bundle)
    publish(tables, out_dir, large=bundle.large_tables())

Cleaning is one narrow chain (projection, filters, one broadcast lookup)
with a single aggregate job in the middle — the null-ratio column rule,
whose outcome decides the schema. The analysis frame is persisted once and
every table reads it; models fit once on one persisted split.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import presets as P
from ..operators import anova, bins, clean, crosstab, geo, models, scale
from ..session import ensure_checkpoint_dir
from ..sources.countries import ALIASES, country_dimension
from ..sources.writers import publish

ROW_ID = "row_id"


@dataclass
class CleanedData:
    raw_df: DataFrame
    clean_df: DataFrame
    clean_valid_df: DataFrame
    analysis_df: DataFrame
    analysis_standardized_df: DataFrame

    def large_tables(self) -> dict[str, DataFrame]:
        return {"clean_df": self.clean_df, "clean_valid_df": self.clean_valid_df,
                "analysis_df": self.analysis_df,
                "analysis_standardized_df": self.analysis_standardized_df}


def create_clean_df(raw: DataFrame, as_of_year: int, iso_dim: DataFrame | None,
                    column_missing_threshold: float = 0.20, item_offset: int = 0) -> DataFrame:
    """Recode, age, geography, scale sums, traits, validity, null rules, select, rename.

    The null rules see every column present at that point (including raw
    columns that are dropped afterwards), exactly as in the source pipeline.
    """
    df = clean.recode_categorical(raw)
    df = clean.clean_age(df, as_of_year)
    if "country" in df.columns:
        if iso_dim is None:
            raise ValueError("the table has countries: pass the country dimension they are looked up in")
        df = clean.attach_geography(df, iso_dim)
    df = clean.score_scales(df, item_offset=item_offset)
    df = clean.score_traits(df)
    df = clean.score_validity(df)
    df = clean.drop_sparse_columns(df, threshold=column_missing_threshold)
    keep = (P.DASS_ITEMS + P.TIPI_ITEMS + P.VCL_ITEMS + P.DEMOGRAPHIC_COLUMNS
            + P.TARGET_COLUMNS + P.TRAITS + P.VCL_NEW_COLUMNS + [ROW_ID])
    df = clean.select_existing(df, keep)
    return clean.rename_columns(df, {**P.DASS_LABELS, **P.TIPI_LABELS, **P.VCL_LABELS})


def clean_survey(raw: DataFrame, as_of_year: int, iso_dim: DataFrame | None = None,
                 column_missing_threshold: float = 0.20, item_offset: int = 0,
                 persist: bool = True, stage_to: str | None = None) -> CleanedData:
    """Build the five frames.

    Every raw row gets a ``row_id`` (unless it has one) from its content, by which the models split
    the rows, whatever the files and partitions. Countries are looked up in ``iso_dim`` or, without one, in the
    dimension of ``sources.countries``.

    ``analysis_df`` feeds every table. By default it is persisted
    (MEMORY_AND_DISK). With ``stage_to`` (a folder on shared storage, e.g.
    under ``spark.checkpoint.dir``) it is written once as Parquet and read
    back, which cuts the lineage: a lost executor then re-reads files instead
    of re-running the cleaning from the raw scan.
    """
    if ROW_ID not in raw.columns:
        raw = clean.content_ids(raw, ROW_ID)
    if iso_dim is None and "country" in raw.columns:
        iso_dim = country_dimension(raw.sparkSession)
    clean_df = create_clean_df(raw, as_of_year, iso_dim, column_missing_threshold, item_offset)
    valid = clean.screen_valid(clean_df)
    analysis = clean.select_existing(valid, [ROW_ID, *P.ANALYSIS_COLUMNS])
    if stage_to:
        analysis.write.mode("overwrite").parquet(stage_to)
        analysis = raw.sparkSession.read.parquet(stage_to)
    elif persist:
        analysis = analysis.persist(StorageLevel.MEMORY_AND_DISK)
    standardized = scale.standardize(analysis, P.STANDARDIZE_COLUMNS)
    return CleanedData(raw, clean_df, valid, analysis, standardized)


def severity_tables(df: DataFrame, digits: int = 2) -> dict[str, DataFrame]:
    """Severity distribution and severity by gender / age group (counts and row %)."""
    df = bins.add_age_group(df, require=False)
    out = {"anxiety_severity_summary": crosstab.band_distribution(
        df, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS, band="anxiety_severity",
        digits=digits)}
    for key, name in (("gender_clean", "gender"), ("age_group", "agegroup")):
        if key not in df.columns:
            continue
        levels = P.AGE_LABELS if key == "age_group" else None
        ct = crosstab.crosstab_bands(df, key, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS,
                                     band="anxiety_severity", complete=True, row_levels=levels,
                                     digits=digits)
        out[f"anxiety_severity_by_{name}_counts"] = crosstab.to_wide(
            ct, key, "anxiety_severity", "n", P.SEVERITY_LABELS)
        out[f"anxiety_severity_by_{name}_percent"] = crosstab.to_wide(
            ct, key, "anxiety_severity", "row_pct", P.SEVERITY_LABELS)
    return out


def severity_by_trait(df: DataFrame, traits: Sequence[str] = P.TRAITS,
                      method: str = "exact", digits: int = 2) -> dict[str, DataFrame]:
    """Severity by trait tertile (Low / Medium / High, ties kept), counts and row %."""
    grouped = bins.quantile_groups(df, traits, n_groups=3, ties="keep", suffix="_group",
                                   method=method)
    out = {}
    for t in traits:
        g = f"{t}_group"
        if g not in grouped.columns:
            continue
        ct = crosstab.crosstab_bands(grouped, g, "dassanxiety", P.SEVERITY_EDGES,
                                     P.SEVERITY_LABELS, band="anxiety_severity", complete=True,
                                     row_levels=P.TERTILE_LABELS, digits=digits)
        key = t.lower().replace(" ", "_")
        out[f"anxiety_severity_by_{key}_counts"] = crosstab.to_wide(
            ct, g, "anxiety_severity", "n", P.SEVERITY_LABELS)
        out[f"anxiety_severity_by_{key}_percent"] = crosstab.to_wide(
            ct, g, "anxiety_severity", "row_pct", P.SEVERITY_LABELS)
    return out


def geo_tables(df: DataFrame, k: int = 10) -> dict[str, DataFrame]:
    out = {}
    if "continent" in df.columns:
        out["mean_anxiety_by_continent"] = geo.mean_by(df, "continent")
    if "country_name" in df.columns:
        out["top10_mean_anxiety_by_country"] = geo.top_k(
            geo.mean_by(df, "country_name"), "mean_anxiety", "country_name", k)
        out["top10_countries_by_participants"] = geo.top_k(
            geo.count_by(df, "country_name"), "n_participants", "country_name", k)
    return out


def anova_tables(df: DataFrame, method: str = "exact") -> dict[str, DataFrame]:
    """Demographic and personality ANOVA summaries."""
    demo, _ = anova.demographic_anova(df, P.DEMOGRAPHIC_FACTORS)
    pers, _ = anova.personality_anova(df, P.TRAITS, n_groups=3, method=method)
    return {"anova_demographics_summary": anova.anova_summary(demo, "factor"),
            "anova_personality_summary": anova.anova_summary(pers, "trait")}


def model_tables(df: DataFrame, rf_trees: int = models.FOREST_TREES, rf_depth: int | None = models.FOREST_DEPTH,
                 gbt_iter: int = models.BOOSTING_ROUNDS, add_derived_factors: bool = False,
                 key: Sequence[str] | None = None) -> dict[str, DataFrame]:
    """Forest importances and the three-model comparison on ONE split.

    With ``add_derived_factors=False`` the model uses the categorical
    predictors present in the table (the source pipeline's behaviour, where
    ``religion_grouped``/``age_group`` are absent); ``True`` derives them first.
    """
    if add_derived_factors:
        df = bins.add_age_group(bins.ensure_regrouped(df), require=False)
    done = models.compare_models(df, rf_trees, rf_depth, gbt_iter, key=key)
    return {"rf_feature_importances": done.importances, "model_comparison": done.models}


def core_tables(bundle: CleanedData, with_models: bool = True, **model_kw) -> dict[str, DataFrame]:
    std = bundle.analysis_standardized_df
    tables = {}
    tables.update(severity_tables(std))
    tables.update(geo_tables(std))
    tables.update(anova_tables(bundle.analysis_df))
    if with_models:
        tables.update(model_tables(std, **model_kw))
    return tables


def export_all_core_tables(bundle: CleanedData, out_dir: str, with_models: bool = True,
                           **model_kw) -> dict:
    """Publish the four large frames (parallel Parquet) and every summary table (CSV)."""
    return publish(core_tables(bundle, with_models, **model_kw), out_dir,
                   large=bundle.large_tables())


def view_tables(std: DataFrame, world: DataFrame | None = None,
                iso_dim: DataFrame | None = None,
                importances: DataFrame | None = None) -> dict[str, DataFrame]:
    """The data behind every figure of the source run (no rendering).

    Histogram (43 bins) and density of the anxiety score, global box
    statistics, box statistics by the eight demographic factors and by trait
    tertiles (ties kept, as in the trait box plots), the severity distribution
    and the observed severity crosstabs by gender and age group, the 9 x 9
    correlation matrix, continent mean and count, the non-response table, the
    coefficient table of the full OLS model tagged for the two forest plots,
    the top-15 of the forest ``importances`` if given and, given a boundary
    table, the choropleth join.
    """
    from ..operators import describe
    out: dict[str, DataFrame] = {}
    out["anxiety_histogram"] = describe.histogram(std, "dassanxiety", bins=43)
    out["anxiety_density"] = describe.density_curve(std, "dassanxiety", grid=200)
    out["anxiety_box_global"] = describe.box_stats_global(std, "dassanxiety")
    demo = bins.add_age_group(bins.ensure_regrouped(std), require=False)
    factors = [f for f in P.DEMOGRAPHIC_FACTORS if f in demo.columns]
    out["anxiety_box_by_demographic"] = describe.box_stats(
        demo, factors, "dassanxiety", exclude=(P.NO_RESPONSE, "Exclude"))
    traits = [t for t in P.TRAITS if t in std.columns]
    names = {t: t.replace(" ", "_") + "_group" for t in traits}
    tert = bins.quantile_groups(std, traits, ties="keep", names=names)
    out["anxiety_box_by_trait_tertile"] = describe.box_stats(
        tert, [names[t] for t in traits if names[t] in tert.columns], "dassanxiety")
    # crosstab form (observed levels and bands only), counts and row % in one table
    for key, name in (("gender_clean", "gender"), ("age_group", "agegroup")):
        if key in demo.columns:
            out[f"severity_crosstab_{name}"] = crosstab.crosstab_bands(
                demo, key, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS,
                band="anxiety_severity", complete=False, digits=2)
    out["anxiety_severity_distribution"] = crosstab.band_distribution(
        std, "dassanxiety", P.SEVERITY_EDGES, P.SEVERITY_LABELS, band="anxiety_severity",
        digits=2)
    out["tipi_dass_correlation"] = describe.correlation_matrix(
        std, [c for c in P.CORRELATION_COLUMNS if c in std.columns])
    if "continent" in std.columns:
        out["continent_mean_count"] = geo.mean_by(std, "continent", with_count=True,
                                                  count_out="count")
    out["nonresponse"] = describe.nonresponse_table(std)
    if "country_name" in std.columns:
        iso_dim = country_dimension(std.sparkSession) if iso_dim is None else iso_dim
        names = [c for c in ALIASES if c in iso_dim.columns]
        means = geo.attach_codes(geo.mean_by(std, "country_name"), iso_dim, aliases=names)
        out["mean_anxiety_by_country_iso"] = means
        if world is not None:
            table = geo.choropleth_table(world, means)
            if table is not None:
                out["choropleth"] = table
    full = full_regression(std)
    out["forest_plot_coefficients"] = models.forest_plot_data(
        full.coefficients, ["dassstress", "dassdepression"] + P.TRAITS)
    if importances is not None:
        out["rf_importances_top15"] = models.importance_plot_data(importances, 15)
    return out


def run_all(spark, raw_path: str, out_dir: str, as_of_year: int, iso_path: str | None = None,
            world_path: str | None = None, fmt: str | None = None, with_models: bool = True,
            rf_trees: int = models.FOREST_TREES, rf_depth: int | None = models.FOREST_DEPTH,
            stage_to: str | None = None) -> dict:
    """The single-command run: load, clean once (into the checkpoint folder unless
    ``stage_to`` says where), publish every table and view; each model is fitted once."""
    from ..sources import readers
    raw = readers.read_table(spark, fmt or "local", raw_path)
    iso = readers.read_iso_dimension(spark, iso_path) if iso_path else None
    world = readers.read_geojson_features(spark, world_path) if world_path else None
    stage_to = stage_to or f"{ensure_checkpoint_dir(spark)}/analysis-{uuid.uuid4().hex}"
    bundle = clean_survey(raw, as_of_year, iso, stage_to=stage_to)
    tables = core_tables(bundle, with_models, rf_trees=rf_trees, rf_depth=rf_depth)
    tables.update(view_tables(bundle.analysis_standardized_df, world, iso,
                              tables.get("rf_feature_importances")))
    tables.update(severity_by_trait(bundle.analysis_standardized_df))
    return publish(tables, out_dir, large=bundle.large_tables())


def regression_models(std: DataFrame) -> dict:
    """M1–M3 on the standardised frame: psychological, + demographics, + traits."""
    df = bins.ensure_regrouped(std)
    psych = ["dassstress", "dassdepression"]
    m1 = models.ols(df.select(*psych, "dassanxiety"), "dassanxiety", psych)
    m2 = models.ols(df, "dassanxiety", psych, P.REGRESSION_CATEGORICALS)
    return {"psychological": m1, "demographic_psych": m2, "full": full_regression(std)}


def full_regression(std: DataFrame) -> models.OLSResult:
    """M3 alone."""
    return models.ols(bins.ensure_regrouped(std), "dassanxiety",
                      ["dassstress", "dassdepression"] + P.TRAITS, P.REGRESSION_CATEGORICALS)


def nonresponse_and_descriptives(df: DataFrame) -> dict[str, DataFrame]:
    from ..operators import describe
    df = df.drop(ROW_ID)
    return {"nonresponse": describe.nonresponse_table(df),
            "numeric_summary": describe.describe_numeric(df),
            "categorical_counts": describe.value_counts(df)}

