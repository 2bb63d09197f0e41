"""Column expressions shared by the operators."""

from .buckets import BUCKET_FORMATS, bucket, bucket_from_text, bucket_text, moment
from .choice import case
from .lookup import lookup_join, measured_bytes
from .measures import count_rows, sum_counts, sum_measures

__all__ = [
    "BUCKET_FORMATS",
    "bucket",
    "bucket_from_text",
    "bucket_text",
    "case",
    "count_rows",
    "lookup_join",
    "measured_bytes",
    "moment",
    "sum_counts",
    "sum_measures",
]
