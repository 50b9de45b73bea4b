"""Column functions: the grammar of lax conversions, and coercions to a column's type."""

from millrace.functions.coerce import compat_cast, csv_text
from millrace.functions.convert import Checked, convert

__all__ = ["Checked", "compat_cast", "convert", "csv_text"]
