"""Dialogue behaviour analytics as Spark DataFrame jobs."""

from talkprint.functions.banks import FEATURES
from talkprint.operators.clean import clean_dialogs
from talkprint.operators.distance import chamfer, compress_cloud, estimate_spread, mean_task_chamfer, overall_chamfer, reference_spread
from talkprint.operators.fingerprint import fingerprint, individual_fingerprints
from talkprint.operators.model import cross_validation, exact_auc, fit_discriminator, importances, load_model, save_model, score
from talkprint.operators.scorecard import Cloud, composite, condition_metrics, report
from talkprint.operators.splits import group_disjoint_split, split, train_val_split
from talkprint.operators.stats import dice_alignment, mean_fingerprint, population_stats
from talkprint.sources.dialogs import read_dialogs, read_keyed_dialogs, read_tasks, read_text_dialogs, to_turns, write_dialogs, write_tasks
from talkprint.sources.shared import Scratch

__version__ = "0.3.0"

__all__ = [
    "Cloud", "FEATURES", "Scratch", "chamfer", "clean_dialogs", "composite", "compress_cloud", "condition_metrics", "cross_validation",
    "dice_alignment", "estimate_spread", "exact_auc", "fingerprint", "fit_discriminator", "group_disjoint_split", "importances",
    "individual_fingerprints", "load_model", "mean_fingerprint", "mean_task_chamfer", "overall_chamfer", "population_stats", "read_dialogs",
    "read_keyed_dialogs", "read_tasks", "read_text_dialogs", "reference_spread", "report", "save_model", "score", "split", "to_turns",
    "train_val_split", "write_dialogs", "write_tasks",
]
