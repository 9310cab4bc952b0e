"""Source files to semantic units: a lexer, an outline parser for C, C++ and Java, and unit extraction. Plain Python, run inside partitions."""

from .outline import Node, parse
from .structure import structure_fingerprint
from .units import Unit, units_of

__all__ = ["Node", "Unit", "parse", "structure_fingerprint", "units_of"]
