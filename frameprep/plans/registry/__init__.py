"""Query registrations, one module per stage."""

from frameprep.plans.registry import cleaning, encoding, features, imbalance, outliers, pipeline, profile, recommend  # noqa: F401
