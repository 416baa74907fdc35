"""Registered queries and their SQL, by subject."""

from __future__ import annotations

from . import q_cloud, q_files, q_frames, q_geometry, q_mesh, q_metrics, q_parts, q_pictures, q_raster, q_surface

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (q_frames, q_surface, q_metrics, q_cloud, q_geometry, q_parts, q_files, q_mesh, q_pictures, q_raster):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.ORACLE_SQL
