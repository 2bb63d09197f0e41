"""Writing results, models and exports."""

from .compaction import compact_results, vacuum_results
from .files import preview, write_csv, write_json
from .models import has_model, load_model, save_model
from .results import append_ip_info, read_results, write_results
from .wide import read_wide, write_wide

__all__ = [
    "append_ip_info",
    "compact_results",
    "has_model",
    "load_model",
    "preview",
    "read_results",
    "read_wide",
    "save_model",
    "vacuum_results",
    "write_csv",
    "write_json",
    "write_results",
    "write_wide",
]
