"""Column functions of the engine, for use in any DataFrame expression."""

from ..operators.biometrics import merge_reason
from ..operators.filters import in_polygon
from ..operators.geometry import aabbs_overlap, cylinder_aabb, frustum, point_in_cylinder
from ..operators.neighbours import cell, distance2

__all__ = ["aabbs_overlap", "cell", "cylinder_aabb", "distance2", "frustum", "in_polygon", "merge_reason", "point_in_cylinder"]
