"""The registered queries over the test tables, and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import operators  # noqa: F401
from .operators import graph, standpoints
from .plans.catalog import composed, over_tables
from .plans.dialect import DUCK
from .sources import derived  # noqa: F401

NAMES = (
    "scan_objects scan_cameras corner_cameras edge_cameras stepped_cameras normalize_type clean_label object_label centroid solid_filter scene_bounds room_size room_pick room_objects name_unique first_per_label "
    "hash_seed view_verdicts iou3d_pairs enrich depth project_fraction project_pixel bbox2d frustum_filter visible_fraction visible_objects shared_views jaccard_pairs visibility_map "
    "closest_object depth_estimation distance_estimation object_distance relative_direction camera_object_position depth_ordering object_size object_count object_grounding depth_difference grounding_bbox object_category "
    "size_qualitative comparative_grounding ordinal_grounding csr_referring csr_multi_step imagination_oc imagination_oo route_planning identify_areas camera_region object_region region_region "
    "camera_relative_position camera_facing_direction camera_motion viewpoint_change object_matching_mv object_object_mv surfaces objects_on_surface placement_feasible object_placement free_space spatial_compatibility "
    "mask_counts mask_visible mask_bbox mask_centroid best_camera ground_truth_points point_projection majority_vote instances percentile_boxes view_support median_offset voxels voxel_neighbours spatial_merge "
    "physics_stability equilibrium_window event_props letter_mcq template_pick dedup_cap "
    "mask_large mask_objects object_instances mask_bbox1000 mask_middle_rows name_unique_in_view name_first_in_view csr_masks mask_fragments view_pixels black_images mask_argmax "
    "point_mask backprojected instance_names weak_labels nearby_pairs merge_candidates merge_votes detections physics_stops physics_summary unstable_bodies task_success "
    "wall_openings door_boxes door_frames window_boxes opening_cuts hinges plan_parts plan_routes door_pairs rotated_corners two_dots one_dot three_dots drawn_boxes box_edges view_results sharp_views picked_views kept_instances movable_types plausible_sizes "
    "splat_cameras camera_groups camera_axes_flipped box_axes_flipped camera_matrices look_targets question_records question_objects type_counts wordings "
    "view_cameras orbit_cameras room_corner_cameras floor_boxes wall_boxes axes_flipped palette rotation_angles merged_names integral_image eroded_cells small_masks merge_roots best_view interleaved direction_choices "
    "surface_views empty_surface_runs empty_surfaces footprint_kernels placement_runs placement_pixels placement_views free_space_views hull_runs answer_masks answer_points point_answers context_views splat_visible movable_prims scene_pick view_detections detection_pairs touching_runs instance_sums merge_verdicts remapped_masks "
    "stage_rooms stage_objects stage_room_objects judged_views judged_cameras judged_counts mesh_corners mesh_bounds"
).split()


def _query(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return over_tables(spark, sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: partial(_query, name=n) for n in NAMES} | {"voxel_components": graph.voxel_components, "split_components": graph.split_components, "merged_points": graph.merged_points, "mask_middles": graph.mask_middles, "merged_detections": graph.merged_detections, "merged_instances": graph.merged_instances, "random_cameras": standpoints.random_cameras}
ORACLE_SQL: dict[str, str] = {n: composed(n, DUCK) for n in NAMES} | graph.oracle_sql()
