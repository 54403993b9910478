"""All pipeline stages; importing the families registers them."""

from docweave.operators import grouping, joins, reshape, rows, series, sinks, system, windows
from docweave.operators.base import STAGES, run_pipeline

__all__ = ["STAGES", "grouping", "joins", "reshape", "rows", "run_pipeline", "series", "sinks", "system", "windows"]
