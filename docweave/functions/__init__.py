"""All expression operators; importing the families registers them."""

from docweave.functions import arithmetic, arrays, convert, core, dates, strings
from docweave.functions.base import META, OPERATORS, ROW_ID, Scope, compile_expression

__all__ = ["META", "OPERATORS", "ROW_ID", "Scope", "arithmetic", "arrays", "compile_expression", "convert", "core", "dates", "strings"]
