"""Operators on enveloped records: hooks, validation, routing, lookups and range expansion."""

from millrace.operators.expand import expand_ranges, lookup, page_anchors
from millrace.operators.hooks import BatchHook, ColumnHook, apply_hooks
from millrace.operators.route import failed, succeeded
from millrace.operators.validate import Validator

__all__ = ["BatchHook", "ColumnHook", "Validator", "apply_hooks", "expand_ranges", "failed", "lookup", "page_anchors", "succeeded"]
