"""Enrich, fit and score: the measurement table is read once to fit, once to score.

A profile depends on the key text only, and in it on the matched keys only.
Fitting therefore reduces the measurements to one weighted row per combination
of matched keys and works on that small table. Scoring is a row-local
expression: no join, no shuffle, nothing broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mixscore.functions.lookup import first_match, label_of, mixture_hits, mixture_profile, normalise_key
from mixscore.functions.text import quoted
from mixscore.operators.decide import CANDIDATES, FLOOR, THRESHOLD, search_needed, used_weights
from mixscore.operators.pca import PcaFit, fit_pca, project
from mixscore.operators.prepare import available_features
from mixscore.plans.table_lookup import enrich_by_table
from mixscore.sources.dictionary import FEATURES, INITIAL_WEIGHTS, SOLVENTS, DictionaryTable, PropertyDictionary
from mixscore.sources.measurements import require_columns

# Columns that exist between two selects only.
LOWERED, FIRST, HITS, PROFILE = "__mix_lowered", "__mix_first", "__mix_hits", "__mix_profile"


@dataclass(frozen=True)
class ProfileModel:
    """A fitted analysis.

    ``profiles`` is a persisted table with one row per combination of matched
    keys: ``n_rows, first_row, Solvent_Main, <properties>``. Its lineage is
    deterministic, so what a lost executor held is computed again.
    """

    dictionary: PropertyDictionary
    solvent: str
    row_id: str
    measurements: DataFrame
    profiles: DataFrame
    fit: PcaFit
    weights: dict[str, float]
    search_needed: bool
    threshold: float

    def release(self) -> None:
        """Free the reduced table; it is computed again if the model is used further."""
        self.profiles.unpersist()

    def scored_profiles(self) -> DataFrame:
        """Combinations with their multiplicity, label and PC1..PC3."""
        return project(self.profiles, self.fit, 3).select(
            "n_rows", "first_row", "Solvent_Main", "PC1", "PC2", "PC3"
        )


def _with_match(df: DataFrame, key: Column, dictionary: PropertyDictionary) -> DataFrame:
    """Append the match columns; each is computed once and read by name from then on."""
    lowered = df.withColumn(LOWERED, F.lower(key))
    return lowered.withColumns(
        {
            FIRST: first_match(LOWERED, dictionary),
            HITS: mixture_hits(LOWERED, dictionary),
        }
    )


def _with_profile(df: DataFrame, dictionary: PropertyDictionary) -> DataFrame:
    return df.withColumns(
        {
            "Solvent_Main": label_of(FIRST, dictionary),
            PROFILE: mixture_profile(FIRST, HITS, dictionary),
        }
    )


def _properties(dictionary: PropertyDictionary) -> list[str]:
    return [f"get({PROFILE}, {i}) AS {quoted(p)}" for i, p in enumerate(dictionary.properties)]


def _kept(df: DataFrame, produced) -> list[str]:
    """Columns of ``df``, quoted, without those that a result replaces."""
    replaced = {p.lower() for p in produced}
    return [quoted(c) for c in df.columns if c.lower() not in replaced]


def enrich(
    df: DataFrame, dictionary: PropertyDictionary | DictionaryTable = SOLVENTS, solvent: str = "Solvent"
) -> DataFrame:
    """Append the main label and the property profile of every row: row by row, or by joins with a dictionary table."""
    if isinstance(dictionary, DictionaryTable):
        return enrich_by_table(df, dictionary, solvent)
    matched = _with_match(df, normalise_key(F.col(quoted(solvent))), dictionary)
    own = _kept(df, ["Solvent_Main", *dictionary.properties])
    return _with_profile(matched, dictionary).selectExpr(*own, "Solvent_Main", *_properties(dictionary))


def distinct_profiles(
    df: DataFrame,
    dictionary: PropertyDictionary = SOLVENTS,
    solvent: str = "Solvent",
    row_id: str = "row_id",
) -> DataFrame:
    """One row per combination of matched keys: multiplicity, first row, label, profile.

    Reads two columns and looks every row's text up in place; only matched
    keys, never texts, are grouped by. Counts combine on the map side, so a key
    that fills a third of the rows, or millions of spellings of few keys,
    reach the shuffle as one row per task and combination.
    """
    matched = _with_match(df, normalise_key(F.col(quoted(solvent))), dictionary)
    combined = matched.groupBy(FIRST, HITS).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(quoted(row_id)).alias("first_row")
    )
    return _with_profile(combined, dictionary).selectExpr(
        "n_rows", "first_row", "Solvent_Main", *_properties(dictionary)
    )


def fit_profile_pca(
    measurements: DataFrame,
    dictionary: PropertyDictionary = SOLVENTS,
    features=FEATURES,
    initial_weights: dict[str, float] = INITIAL_WEIGHTS,
    solvent: str = "Solvent",
    row_id: str = "row_id",
    threshold: float = THRESHOLD,
    floor: float = FLOOR,
    candidates: int = CANDIDATES,
    search: bool = True,
) -> ProfileModel:
    """Fit the PCA of the row profiles and choose the feature weights.

    Weighting before standardising cancels, so the fit does not depend on the
    weights and needs no repetition after the search. ``search=False`` skips
    the search for callers that use no weights.
    """
    require_columns(measurements, [solvent, row_id])
    profiles = distinct_profiles(measurements, dictionary, solvent, row_id).persist()
    fit = fit_pca(profiles, available_features(profiles, features), weight="n_rows")
    spark = measurements.sparkSession
    weights = (
        used_weights(spark, fit, initial_weights, threshold, floor, candidates)
        if search
        else {f: float(initial_weights[f]) for f in fit.features}
    )
    return ProfileModel(
        dictionary=dictionary,
        solvent=solvent,
        row_id=row_id,
        measurements=measurements,
        profiles=profiles,
        fit=fit,
        weights=weights,
        search_needed=search_needed(fit, threshold),
        threshold=threshold,
    )


def score_names(model: ProfileModel) -> list[str]:
    """Names of the score columns: three, or fewer when the fit has fewer components."""
    return [f"Solvent_PC{j + 1}" for j in range(min(3, model.fit.k))]


def key_scores(model: ProfileModel) -> PropertyDictionary | None:
    """The dictionary with its rows replaced by their scores, or None if a feature has gaps.

    A score is affine in the profile and a mixture is a mean of rows, so the
    scores of a mixture are the mean of its parts' scores. That fails only
    where a missing property has to be imputed for the mixture as a whole.
    """
    m, d, names = model.fit.moments, model.dictionary, score_names(model)
    values = [d.values(f) for f in m.features]
    if any(v is None for column in values for v in column):
        return None
    scale = np.where(m.sd > 0, 1.0 / np.where(m.sd > 0, m.sd, 1.0), 0.0)
    z = (np.array(values, dtype=float).T - m.mean) * scale
    scores = z @ np.nan_to_num(model.fit.loadings[:, : len(names)])
    return PropertyDictionary.from_rows(
        names, [(k, *map(float, s)) for k, s in zip(d.keys, scores)], d.default_key, d.match
    )


def score_rows(df: DataFrame, model: ProfileModel) -> DataFrame:
    """Label and scores for any measurement rows, seen or new, batch or stream."""
    names = score_names(model)
    own = _kept(df, [*names, "Solvent_Main"])
    matched = _with_match(df, normalise_key(F.col(quoted(model.solvent))), model.dictionary)
    scores = key_scores(model)
    if scores is not None:
        return _with_profile(matched, scores).selectExpr(*own, *_properties(scores), "Solvent_Main")
    at = model.dictionary.properties.index
    scored = project(
        _with_profile(matched, model.dictionary), model.fit, len(names),
        prefix="Solvent_PC", values=lambda f: f"get({PROFILE}, {at(f)})",
    )
    return scored.select(*own, *names, "Solvent_Main")


def fitted_rows(model: ProfileModel) -> DataFrame:
    """The measurements of the fit with ``Solvent_PC1..3`` and ``Solvent_Main``."""
    return score_rows(model.measurements, model)
