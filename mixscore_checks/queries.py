"""One registered query per operator of the engine."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mixscore.functions.lookup import normalise_key, with_main_label
from mixscore.functions.scalars import with_default
from mixscore.operators import decide, groups, pca, prepare
from mixscore.operators.moments import correlation_frame, moments
from mixscore.operators.shape import shape_report
from mixscore.plans import charts, enrich, fit_profile_pca, fitted_rows, report
from mixscore.sources.dictionary import (
    DISPLAY_LABELS,
    FEATURES,
    INITIAL_WEIGHTS,
    SOLVENTS,
    labels_frame,
    weights_frame,
)
from mixscore.sources.measurements import scan_measurements
from mixscore_checks.session import work_folder
from mixscore_checks.views import (
    LINE_FEATURES,
    LINE_FEATURES_4,
    gappy_lines,
    line_texts,
    lines,
    measurements,
    part_dictionary,
    table,
)

# Weights of the three-feature sweep over line items.
LINE_WEIGHTS = {"l_quantity": 1.5, "l_extendedprice": 0.05, "l_discount": 0.7}


def r6(value: Column | str) -> Column:
    """Six decimals without a negative zero, so that both engines hash the same value."""
    column = F.col(f"`{value}`") if isinstance(value, str) else value
    return F.rint(column * 1e6) / 1e6 + F.lit(0.0)


def rounded(df: DataFrame) -> DataFrame:
    """Every double column to six decimals, integers as bigint."""
    return df.select(
        *[
            r6(n).alias(n) if t == "double" else F.col(f"`{n}`").cast("bigint").alias(n) if t == "int" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


def _model(spark, sf_dir, search=False):
    return fit_profile_pca(measurements(spark, sf_dir), search=search)


def _line_fit(spark, sf_dir):
    return pca.fit_pca(lines(spark, sf_dir), LINE_FEATURES)


def _line_variance(spark, sf_dir):
    return pca.variance_frame(spark, _line_fit(spark, sf_dir))


# --- lookup -----------------------------------------------------------------

def normalise_and_label(spark, sf_dir):
    keyed = measurements(spark, sf_dir).select("row_id", normalise_key(F.col("Solvent")).alias("solvent_key"))
    return with_main_label(keyed, F.col("solvent_key"), SOLVENTS, "label")


def label_counts(spark, sf_dir):
    rows = measurements(spark, sf_dir).select("Solvent")
    labelled = with_main_label(rows, normalise_key(F.col("Solvent")), SOLVENTS, "label")
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def label_texts(spark, sf_dir):
    """The keyword lookup over free text: names, document texts, page sources."""
    parts = []
    for name, key, text in (
        ("part", "p_partkey", "p_name"),
        ("documents", "doc_id", "text"),
        ("pages", "page_id", "html"),
    ):
        rows = table(spark, sf_dir, name).select(F.lit(name).alias("source"), F.col(key).alias("id"), text)
        parts.append(with_main_label(rows, normalise_key(F.col(text)), SOLVENTS, "label").drop(text))
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def mixture_profile(spark, sf_dir):
    return rounded(
        enrich(measurements(spark, sf_dir)).select("row_id", "Solvent_Main", *SOLVENTS.properties)
    )


def long_dictionary(spark, sf_dir):
    """A dictionary with a key for each part over the texts of all line items."""
    enriched = enrich(line_texts(spark, sf_dir), part_dictionary(spark, sf_dir), "t")
    return rounded(
        enriched.select("l_orderkey", "l_linenumber", "l_partkey", F.col("Solvent_Main").alias("label"), "size", "price")
    )


def longest_match(spark, sf_dir):
    """Labels where a key inside a longer one's occurrence doesn't count."""
    dictionary = replace(SOLVENTS, match="longest")
    rows = measurements(spark, sf_dir).select("row_id", "Solvent")
    return with_main_label(rows, normalise_key(F.col("Solvent")), dictionary, "label").drop("Solvent")


# --- preparation ------------------------------------------------------------

def impute_mean(spark, sf_dir):
    filled = prepare.impute_mean(gappy_lines(spark, sf_dir), ["l_discount", "l_tax"])
    return rounded(filled.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax"))


def standardise(spark, sf_dir):
    features = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "constant"]
    scaled = prepare.standardise(gappy_lines(spark, sf_dir), features)
    return rounded(scaled.select("l_orderkey", "l_linenumber", "l_partkey", *features))


def correlation_lines(spark, sf_dir):
    return rounded(correlation_frame(spark, moments(lines(spark, sf_dir), LINE_FEATURES_4)))


def correlation_profiles(spark, sf_dir):
    return rounded(correlation_frame(spark, _model(spark, sf_dir).fit.moments))


def weight_invariance(spark, sf_dir):
    """Weighting before standardising leaves every correlation as it was."""
    model = _model(spark, sf_dir)
    plain = correlation_frame(spark, model.fit.moments)
    weighted = prepare.weight_features(model.profiles, INITIAL_WEIGHTS)
    other = correlation_frame(spark, moments(weighted, FEATURES, weight="n_rows"))
    pairs = plain.join(other.withColumnRenamed("corr", "weighted"), ["feature_a", "feature_b"])
    return rounded(
        pairs.select("feature_a", "feature_b", "corr", (F.abs(F.col("corr") - F.col("weighted")) < 1e-9).alias("same"))
    )


# --- principal components ---------------------------------------------------

def pca3_variance(spark, sf_dir):
    return rounded(_line_variance(spark, sf_dir))


def pca3_loadings(spark, sf_dir):
    return rounded(pca.loadings_frame(spark, _line_fit(spark, sf_dir)).drop("ord"))


def pca3_scores(spark, sf_dir):
    rows = lines(spark, sf_dir)
    scored = pca.project(rows, pca.fit_pca(rows, LINE_FEATURES), 3)
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "PC1", "PC2", "PC3"))


def pca2_scores(spark, sf_dir):
    """Two features only: the third component is null."""
    rows = lines(spark, sf_dir)
    scored = pca.project(rows, pca.fit_pca(rows, ("l_quantity", "l_discount")), 3)
    return rounded(scored.select("l_orderkey", "l_linenumber", "l_partkey", "PC1", "PC2", "PC3"))


def _profile_loadings(spark, sf_dir, first, last):
    frame = pca.loadings_frame(spark, _model(spark, sf_dir).fit)
    return rounded(frame.where(F.col("component").between(first, last)).drop("ord"))


def pca15_pc1(spark, sf_dir):
    return _profile_loadings(spark, sf_dir, 1, 1)


def pca15_pc2_pc3(spark, sf_dir):
    return _profile_loadings(spark, sf_dir, 2, 3)


def pca15_pc4_pc9(spark, sf_dir):
    return _profile_loadings(spark, sf_dir, 4, 9)


def pca15_variance(spark, sf_dir):
    return rounded(pca.variance_frame(spark, _model(spark, sf_dir).fit))


def variance_table(spark, sf_dir):
    return rounded(report.variance_table(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def decision(spark, sf_dir):
    return rounded(decide.decision(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def headline(spark, sf_dir):
    return rounded(decide.headline(decide.decision(pca.variance_frame(spark, _model(spark, sf_dir).fit))))


def axis_labels(spark, sf_dir):
    return rounded(charts.axis_labels(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def decision_lines(spark, sf_dir):
    return rounded(decide.decision(_line_variance(spark, sf_dir)))


# --- rows -------------------------------------------------------------------

def score_table(spark, sf_dir):
    return rounded(report.score_table(_model(spark, sf_dir)))


def enriched_table(spark, sf_dir):
    return rounded(fitted_rows(_model(spark, sf_dir)))


def profile_scores(spark, sf_dir):
    """The same scores from the full profile of each row."""
    model = _model(spark, sf_dir)
    rows = pca.project(enrich(measurements(spark, sf_dir)), model.fit, 3, prefix="Solvent_PC")
    return rounded(rows.select("row_id", "Solvent_PC1", "Solvent_PC2", "Solvent_PC3", "Solvent_Main"))


# --- weights ----------------------------------------------------------------

def weight_sweep(spark, sf_dir):
    fit = _model(spark, sf_dir).fit
    swept = decide.sweep_weights(decide.candidate_weights(spark, INITIAL_WEIGHTS), fit.moments)
    return rounded(swept.select("cand_id", "cum2", "objective", F.posexplode("weights").alias("ord", "weight")))


def weight_sweep_best(spark, sf_dir):
    fit = _model(spark, sf_dir).fit
    swept = decide.sweep_weights(decide.candidate_weights(spark, INITIAL_WEIGHTS), fit.moments)
    best = decide.best_candidate(swept).select("cand_id", "cum2", "objective", F.posexplode("weights").alias("ord", "weight"))
    return rounded(best)


def weight_sweep_lines(spark, sf_dir):
    """Three features, one initial weight under the floor."""
    swept = decide.sweep_weights(
        decide.candidate_weights(spark, LINE_WEIGHTS), moments(lines(spark, sf_dir), LINE_FEATURES)
    )
    best = decide.best_candidate(swept).select("cand_id", "cum2", "objective", F.posexplode("weights").alias("ord", "weight"))
    return rounded(best)


def weight_table(spark, sf_dir):
    return rounded(report.feature_weight_table(_model(spark, sf_dir, search=True)))


def weight_bars(spark, sf_dir):
    return rounded(charts.weight_bars(_model(spark, sf_dir, search=True)))


# --- groups -----------------------------------------------------------------

def label_ellipses(spark, sf_dir):
    return rounded(charts.label_ellipses(_model(spark, sf_dir)))


def line_ellipses(spark, sf_dir):
    """Ellipses of raw rows by a column with few, large groups."""
    rows = prepare.standardise(lines(spark, sf_dir), ["l_quantity", "l_extendedprice"])
    return rounded(groups.group_ellipse(rows, "l_returnflag", "l_quantity", "l_extendedprice"))


def order_ellipses(spark, sf_dir):
    """Ellipses by a column with many small groups, some under three rows."""
    rows = prepare.standardise(lines(spark, sf_dir), ["l_quantity", "l_discount"])
    return rounded(groups.group_ellipse(rows, "l_orderkey", "l_quantity", "l_discount"))


def raw_ellipses(spark, sf_dir):
    """Ellipses of raw columns whose spreads differ by orders of magnitude."""
    return rounded(groups.group_ellipse(lines(spark, sf_dir), "l_orderkey", "l_quantity", "l_discount"))


def collinear_ellipses(spark, sf_dir):
    """Groups whose points lie on a line: a row for each, with a minor axis of zero."""
    price = F.col("l_extendedprice") / 1000
    rows = lines(spark, sf_dir).select("l_orderkey", price.alias("x"), (3 * price + 7).alias("y"))
    return rounded(groups.group_ellipse(rows, "l_orderkey", "x", "y"))


def order_ordinals(spark, sf_dir):
    """Orders by the line number, part and supplier they first appear with: a rank of very many groups."""
    rows = lines(spark, sf_dir).withColumn("place", F.expr("l_partkey * 1000000000 + l_orderkey * 10 + l_linenumber"))
    return groups.group_ordinals(rows, "l_orderkey", "place")


def label_ordinals(spark, sf_dir):
    return charts.label_ordinals(_model(spark, sf_dir))


# --- charts -----------------------------------------------------------------

def loading_strength(spark, sf_dir):
    return rounded(charts.loading_arrows(spark, _model(spark, sf_dir).fit))


def loadings_wide(spark, sf_dir):
    return rounded(report.loadings_table(_model(spark, sf_dir)))


def loadings_heatmap(spark, sf_dir):
    return rounded(charts.loadings_heatmap(spark, _model(spark, sf_dir).fit))


def biplot_arrows(spark, sf_dir):
    model = _model(spark, sf_dir)
    return rounded(charts.biplot_arrows(spark, model.fit, charts.score_extent(model)))


def biplot_points(spark, sf_dir):
    return rounded(charts.biplot_points(_model(spark, sf_dir)))


def scree(spark, sf_dir):
    return rounded(charts.scree(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def variance_percent(spark, sf_dir):
    return rounded(charts.variance_percent(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def cumulative_curve(spark, sf_dir):
    fit = _model(spark, sf_dir).fit
    variance = pca.variance_frame(spark, fit)
    return rounded(charts.cumulative_curve(variance, decide.components_to(fit)))


def eigenvalue_bars(spark, sf_dir):
    return rounded(charts.eigenvalue_bars(pca.variance_frame(spark, _model(spark, sf_dir).fit)))


def score_points(spark, sf_dir):
    return rounded(charts.score_points(_model(spark, sf_dir)))


def score_points_3d(spark, sf_dir):
    return rounded(charts.score_points_3d(_model(spark, sf_dir)))


def shape(spark, sf_dir):
    rows = measurements(spark, sf_dir)
    return shape_report({"measurements": rows, "profiles": enrich(rows).select(*FEATURES)})


def display_labels(spark, sf_dir):
    """The profile correlations under display labels; features without one keep their name."""
    frame = correlation_frame(spark, _model(spark, sf_dir).fit.moments)
    return rounded(
        frame.select(
            with_default(DISPLAY_LABELS, F.col("feature_a")).alias("label_a"),
            with_default({"eps": "Dielectric constant"}, F.col("feature_b")).alias("label_b"),
            "corr",
        )
    )


# --- scan, writers, dimension tables -----------------------------------------

def scanned_rows(spark, sf_dir):
    """The measurements written as files in row order, then scanned with row ids by file and position."""
    folder = work_folder(spark)
    ordered = measurements(spark, sf_dir).repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    ordered.drop("row_id").write.parquet(folder)
    return rounded(scan_measurements(spark, folder, add_row_id=True))


def scanned_csv(spark, sf_dir):
    """The same from CSV, whose missing cells are texts."""
    folder = work_folder(spark)
    ordered = measurements(spark, sf_dir).repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    ordered.drop("row_id").write.option("header", True).option("nullValue", "NA").csv(folder)
    rows = scan_measurements(spark, folder, fmt="csv", add_row_id=True)
    firsts = groups.group_ordinals(rows, "Solvent", "row_id").select("Solvent", "ordinal")
    counts = rows.groupBy("Solvent").agg(F.count(F.lit(1)).alias("n"), F.sum("`Ex(nm)`").alias("ex_nm"))
    return rounded(counts.join(firsts, "Solvent"))


def scanned_csv_rows(spark, sf_dir):
    """Row ids of CSV files: gapless, in the order of files and lines."""
    folder = work_folder(spark)
    ordered = measurements(spark, sf_dir).repartitionByRange(3, "row_id").sortWithinPartitions("row_id")
    ordered.drop("row_id").write.option("header", True).option("nullValue", "NA").csv(folder)
    rows = rounded(scan_measurements(spark, folder, fmt="csv", add_row_id=True))
    return rows.select("row_id", "Name", "Solvent", "`Ex(nm)`")


def _written(name):
    """One of the five tables that ``run`` writes, read back."""

    def query(spark, sf_dir):
        folder = work_folder(spark)
        report.run(measurements(spark, sf_dir), folder).release()
        return rounded(spark.read.parquet(f"{folder}/{name}"))

    return query


def dictionary_rows(spark, sf_dir):
    """The property dimension joined with the rows that carry each label."""
    return rounded(label_counts(spark, sf_dir).join(SOLVENTS.frame(spark), F.col("label") == F.col("key")).drop("key"))


def weighted_loadings(spark, sf_dir):
    """Weight and label dimensions joined with the first component's loadings."""
    loadings = pca.loadings_frame(spark, _model(spark, sf_dir).fit).where("component = 1").drop("ord")
    named = weights_frame(spark).join(labels_frame(spark), "property").join(loadings, F.col("property") == F.col("feature"))
    return rounded(named.select("label", "weight", (F.col("weight") * F.col("loading")).alias("weighted")))


QUERIES = {
    "q01_normalise_and_label": normalise_and_label,
    "q01b_label_counts": label_counts,
    "q01c_label_texts": label_texts,
    "q01d_long_dictionary": long_dictionary,
    "q01e_longest_match": longest_match,
    "q02_mixture_profile": mixture_profile,
    "q03_impute_mean": impute_mean,
    "q04_standardise": standardise,
    "q05_correlation_long": correlation_lines,
    "q05b_correlation_profiles": correlation_profiles,
    "q06_pca3_variance": pca3_variance,
    "q07_pca3_loadings": pca3_loadings,
    "q07b_pca3_scores": pca3_scores,
    "q07c_pca2_scores": pca2_scores,
    "q08_pca15_pc1": pca15_pc1,
    "q09_pca15_pc2_pc3": pca15_pc2_pc3,
    "q09b_pca15_pc4_pc9": pca15_pc4_pc9,
    "q10_scores": score_table,
    "q10b_enriched": enriched_table,
    "q10c_profile_scores": profile_scores,
    "q11_variance_table": variance_table,
    "q11b_variance": pca15_variance,
    "q12_n85_and_flags": decision,
    "q12b_n85_and_flags_lines": decision_lines,
    "q12c_headline": headline,
    "q12d_axis_labels": axis_labels,
    "q13_weight_invariance": weight_invariance,
    "q14_weight_sweep": weight_sweep,
    "q14b_weight_sweep_best": weight_sweep_best,
    "q14c_weight_sweep_lines": weight_sweep_lines,
    "q15_loading_strength": loading_strength,
    "q16_weight_table": weight_table,
    "q16b_weight_bars": weight_bars,
    "q17_group_ellipse": label_ellipses,
    "q17b_group_ellipse_lines": line_ellipses,
    "q17c_group_ellipse_orders": order_ellipses,
    "q17d_group_ellipse_raw": raw_ellipses,
    "q17e_group_ellipse_collinear": collinear_ellipses,
    "q18_group_ordinal": label_ordinals,
    "q18b_group_ordinal_orders": order_ordinals,
    "q19_loadings_wide": loadings_wide,
    "q19b_loadings_heatmap": loadings_heatmap,
    "q20_biplot": biplot_arrows,
    "q20b_biplot_points": biplot_points,
    "q21_scree": scree,
    "q21b_variance_percent": variance_percent,
    "q22_cumulative": cumulative_curve,
    "q23_eigen": eigenvalue_bars,
    "q24_points3d": score_points_3d,
    "q24b_points": score_points,
    "q25_shape": shape,
    "q26_display_labels": display_labels,
    "q27_scanned_rows": scanned_rows,
    "q27b_scanned_csv": scanned_csv,
    "q27c_scanned_csv_rows": scanned_csv_rows,
    "q28_written_enriched": _written("enriched"),
    "q28b_written_plot_data": _written("plot_data"),
    "q28c_written_variance": _written("variance"),
    "q28d_written_loadings": _written("loadings"),
    "q28e_written_feature_weights": _written("feature_weights"),
    "q29_dictionary_rows": dictionary_rows,
    "q29b_weighted_loadings": weighted_loadings,
}
