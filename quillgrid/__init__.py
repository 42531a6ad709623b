"""Spark-native workbook and table analytics."""

from .budget import Budget
from .compare import ReconcileOptions, reconcile, reconcile_frame
from .errors import BudgetError, EngineError, UnsupportedError
from .workbook import Workbook

__all__ = ["Budget", "BudgetError", "EngineError", "ReconcileOptions", "UnsupportedError", "Workbook", "reconcile", "reconcile_frame"]
