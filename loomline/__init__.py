"""Loomline: a small, strictly typed SQL dialect on Spark DataFrames."""

from loomline.engine import Engine, ResultRow
from loomline.plans.logical import format_plan

__all__ = ["Engine", "ResultRow", "format_plan"]
