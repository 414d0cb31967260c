"""Tabular analytics on Spark: profile, clean, derive, test, model, chart, plan and retrieve."""

import sys

from pyspark import cloudpickle

from plumbline.config import EngineConfig
from plumbline.plans import flows, roles
from plumbline.session import build_session, materialise
from plumbline.sources.tables import load_documents, load_model, load_table, save_model, save_results, save_table

__all__ = [
    "EngineConfig", "build_session", "flows", "load_documents", "load_model", "load_table", "materialise", "roles",
    "save_model", "save_results", "save_table",
]

# Functions sent to executors travel with the job, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
