"""The query catalogue."""

from voxelframe.plans import arrays, formats, images, metadata  # noqa: F401
from voxelframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
