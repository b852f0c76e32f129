"""Operators: relations over scenes, views, masks and points."""

from . import areas, cameras, clouds, drawing, extras, masks, pairs, pixels, placement, poses, questions, rays, records, scans, splats, stages, walls  # noqa: F401
