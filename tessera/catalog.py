"""All registered queries of the library."""

from tessera.queries import cna, learn, sv  # noqa: F401  they register themselves
from tessera.queries.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
