"""tabwise — profile, clean, model and score tables as Spark jobs.

Every operator takes DataFrames and returns DataFrames (or a small fitted model whose outputs are DataFrames).
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package that run inside Spark tasks (pandas UDF bodies) are pickled by value, so executors
# need no installed copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

from .operators.advise import suggest, validate  # noqa: E402
from .operators.catalog import (  # noqa: E402
    clear_results, hide_columns, latest_runs, log_run, patch, restore_config, search, split_by, visible)
from .operators.dbscan import dbscan  # noqa: E402
from .operators.evaluate import accuracy, classification_metrics, confusion, regression_metrics  # noqa: E402
from .operators.iforest import isolation_forest  # noqa: E402
from .operators.kmeans import kmeans, kmeans_from  # noqa: E402
from .operators.knn import knn  # noqa: E402
from .operators.pca import pca, pca_reduce  # noqa: E402
from .operators.prep import fit_prep, fit_scaler  # noqa: E402
from .operators.profile import missing_report, profile, summary  # noqa: E402
from .operators.ridge import ridge  # noqa: E402
from .operators.stats import exact_medians  # noqa: E402
from .operators.target import choose_target  # noqa: E402
from .operators.trees import best_split, forest, tree  # noqa: E402
from .sources import add_key, read_any, read_csv, read_json, read_table, write_csv, write_table  # noqa: E402

__all__ = [
    "accuracy", "add_key", "best_split", "choose_target", "classification_metrics", "clear_results", "confusion",
    "dbscan", "exact_medians", "fit_prep", "fit_scaler", "forest", "hide_columns", "isolation_forest", "kmeans",
    "kmeans_from", "knn", "latest_runs", "log_run", "missing_report", "patch", "pca", "pca_reduce", "profile",
    "read_any", "read_csv", "read_json", "read_table", "regression_metrics", "restore_config", "ridge", "search",
    "split_by", "suggest", "summary", "tree", "validate", "visible", "write_csv", "write_table",
]
