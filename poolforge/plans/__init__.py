"""The registered queries, by group of operators; importing this package registers them all."""

from . import q_counts, q_extraction, q_functions, q_inference, q_metadata, q_more, q_profiles, q_qc, q_reports, q_scoring, q_sources, q_trimming  # noqa: F401
