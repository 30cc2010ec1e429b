from mixscore.plans.charts import summary_charts
from mixscore.plans.model import (
    ProfileModel,
    distinct_profiles,
    enrich,
    fit_profile_pca,
    fitted_rows,
    score_rows,
)
from mixscore.plans.report import report_tables, run, write_tables

__all__ = [
    "ProfileModel",
    "distinct_profiles",
    "enrich",
    "fit_profile_pca",
    "fitted_rows",
    "report_tables",
    "run",
    "score_rows",
    "summary_charts",
    "write_tables",
]
