"""Exact algebra of units of measure."""

from .algebra import Lin, Quantity, UnitFault, combine, compare, exp_of, log_of, power
from .catalog import Catalog, default_catalog
from .text import UnknownUnit, describe, parse, spell

__all__ = ["Catalog", "Lin", "Quantity", "UnitFault", "UnknownUnit", "combine", "compare", "default_catalog", "describe", "exp_of", "log_of", "parse", "power", "spell"]
