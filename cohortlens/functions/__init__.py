"""Column-expression helpers: everything here returns a ``pyspark.sql.Column``
built from built-in functions, so it stays inside whole-stage codegen."""

from cohortlens.functions.rowwise import row_mean, row_std, row_sum, row_count  # noqa: F401
from cohortlens.functions.categorize import (  # noqa: F401
    level_band,
    lookup,
    parental_decode,
    subject_category,
    tier_bin,
    title_case,
    yes_no_decode,
)
from cohortlens.functions.mathx import clip, logistic, sample_skewness  # noqa: F401
