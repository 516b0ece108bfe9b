"""All registered queries (``QUERIES``) and their DuckDB oracles (``ORACLES``).

Importing this module imports every query module, whose ``@register`` decorators
fill the catalog.
"""

from clinloom import queries_core, queries_io, queries_linkage, queries_ml  # noqa: F401
from clinloom.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
