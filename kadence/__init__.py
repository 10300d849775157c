"""k-dependence Bayesian network classifiers learned and applied as Spark jobs."""

from kadence.operators.compiled import CompiledModel, compile_model, load_compiled
from kadence.operators.evaluate import model_size, prune_model, prune_structure
from kadence.operators.params import conditional_counts, model_table
from kadence.operators.star import Dim, encode_star, key_sketches, star_join
from kadence.plans.learning import (
    learn_parameters,
    learn_parameters_star,
    learn_structure,
    learn_structure_star,
)
from kadence.plans.scoring import loocv, predict_classes, predict_proba, predict_profiles, predict_sample
from kadence.sources.staging import staging_run
from kadence.sources.tables import (
    load_model,
    load_structure,
    model_summary,
    save_model,
    save_structure,
    write_predictions,
)
from kadence.sources.training import encode_categories, read_training
from kadence.streaming.incremental import add_rows, compact_log, count_stream, drop_covered, logged_counts, remove_rows

__all__ = [
    "CompiledModel",
    "Dim",
    "add_rows",
    "compact_log",
    "compile_model",
    "conditional_counts",
    "count_stream",
    "drop_covered",
    "encode_categories",
    "encode_star",
    "key_sketches",
    "learn_parameters",
    "learn_parameters_star",
    "learn_structure",
    "learn_structure_star",
    "load_compiled",
    "load_model",
    "load_structure",
    "logged_counts",
    "loocv",
    "model_size",
    "model_summary",
    "model_table",
    "predict_classes",
    "predict_proba",
    "predict_profiles",
    "predict_sample",
    "prune_model",
    "prune_structure",
    "read_training",
    "remove_rows",
    "save_model",
    "save_structure",
    "staging_run",
    "star_join",
    "write_predictions",
]
