"""How operators lay data out: blocked series, running totals, skew-safe joins."""

from tickloom.plans.joins import attach, join_on
from tickloom.plans.series import Layout, Series, arrange, row_index
from tickloom.plans.running import run_over, running

__all__ = ["Layout", "Series", "arrange", "attach", "join_on", "row_index", "run_over", "running"]
