"""Queries over the driver tables, each with its SQL twin where SQL can say it."""
from .registry import ORACLES, QUERIES
from . import q_score, q_clean, q_window, q_sample, q_model, q_linear, q_full_size, q_diag, q_store  # noqa: F401
