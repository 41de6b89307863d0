"""Registered queries, one module per operator family."""

from cohortlens.plans.catalog import core, encode, evaluate, export, models, quality, reshape, scoring  # noqa: F401
