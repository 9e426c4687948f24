"""Settings of the detection stages: dotted access, JSON files, and their checks as a relation of messages."""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Defaults of the settings that are checked.
DEFAULTS: dict[str, dict[str, Any]] = {
    "preprocess": {
        "min_width": 100, "max_width": 2000, "min_height": 100, "max_height": 2000, "scale_factor": 1.0, "blur_kernel_size": 5, "median_blur_kernel_size": 5,
        "adaptive_block_size": 11, "canny_low_threshold": 50, "canny_high_threshold": 150, "clahe_clip_limit": 2.0, "deskew_max_angle": 15.0,
    },
    "shape": {"min_rect_area": 500, "min_circularity": 0.5, "min_shape_area": 200, "rect_aspect_ratio_low": 0.1},
    "arrow": {
        "hough_min_line_length": 15, "hough_max_line_gap": 15, "min_line_length": 10, "arrowhead_detection_radius": 30, "merge_angle_tolerance_deg": 15.0, "dedup_angle_tolerance_deg": 8.0,
        "dedup_lateral_tolerance": 6, "dedup_projection_overlap": 0.5, "event_boundary_tolerance": 20.0, "aoa_min_event_circles": 2, "aoa_circle_dominance": 0.5, "node_connection_tolerance": 30,
        "arrowhead_min_confidence": 0.1,
    },
    "ocr": {"min_confidence": 0.0, "high_confidence": 0.7, "low_confidence": 0.3, "group_distance_threshold": 40.0},
}

#: (section, setting, what must hold, as SQL over the section's settings)
CHECKS: tuple[tuple[str, str, str], ...] = (
    ("preprocess", "max_width", "max_width >= min_width"),
    ("preprocess", "max_height", "max_height >= min_height"),
    ("preprocess", "scale_factor", "scale_factor > 0"),
    ("preprocess", "blur_kernel_size", "blur_kernel_size >= 1"),
    ("preprocess", "blur_kernel_size", "blur_kernel_size % 2 <> 0"),
    ("preprocess", "median_blur_kernel_size", "median_blur_kernel_size >= 1"),
    ("preprocess", "median_blur_kernel_size", "median_blur_kernel_size % 2 <> 0"),
    ("preprocess", "adaptive_block_size", "adaptive_block_size >= 3"),
    ("preprocess", "adaptive_block_size", "adaptive_block_size % 2 <> 0"),
    ("preprocess", "canny_low_threshold", "canny_low_threshold >= 0"),
    ("preprocess", "canny_high_threshold", "canny_high_threshold >= canny_low_threshold"),
    ("preprocess", "clahe_clip_limit", "clahe_clip_limit > 0"),
    ("preprocess", "deskew_max_angle", "deskew_max_angle > 0"),
    ("shape", "min_rect_area", "min_rect_area >= 0"),
    ("shape", "min_circularity", "min_circularity between 0 and 1"),
    ("shape", "min_shape_area", "min_shape_area >= 0"),
    ("shape", "rect_aspect_ratio_low", "rect_aspect_ratio_low > 0"),
    ("arrow", "hough_min_line_length", "hough_min_line_length >= 1"),
    ("arrow", "hough_max_line_gap", "hough_max_line_gap >= 0"),
    ("arrow", "min_line_length", "min_line_length >= 1"),
    ("arrow", "arrowhead_detection_radius", "arrowhead_detection_radius >= 1"),
    ("arrow", "merge_angle_tolerance_deg", "merge_angle_tolerance_deg > 0"),
    ("arrow", "dedup_angle_tolerance_deg", "dedup_angle_tolerance_deg > 0"),
    ("arrow", "dedup_lateral_tolerance", "dedup_lateral_tolerance >= 0"),
    ("arrow", "dedup_projection_overlap", "dedup_projection_overlap > 0 and dedup_projection_overlap <= 1"),
    ("arrow", "event_boundary_tolerance", "event_boundary_tolerance > 0"),
    ("arrow", "aoa_min_event_circles", "aoa_min_event_circles >= 1"),
    ("arrow", "aoa_circle_dominance", "aoa_circle_dominance > 0 and aoa_circle_dominance <= 1"),
    ("arrow", "node_connection_tolerance", "node_connection_tolerance >= 1"),
    ("arrow", "arrowhead_min_confidence", "arrowhead_min_confidence between 0 and 1"),
    ("ocr", "min_confidence", "min_confidence between 0 and 1"),
    ("ocr", "high_confidence", "high_confidence >= min_confidence"),
    ("ocr", "low_confidence", "low_confidence >= min_confidence"),
    ("ocr", "group_distance_threshold", "group_distance_threshold > 0"),
)


def setting_issues(settings: DataFrame, section: str) -> DataFrame:
    """settings (config_id and a section's settings as columns; others keep their defaults) -> config_id, setting, rule of each rule that is broken."""
    given = settings.select("config_id", *[(F.col(k) if k in settings.columns else F.lit(v)).alias(k) for k, v in DEFAULTS[section].items()])
    broken = [F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.struct(F.lit(name).alias("setting"), F.lit(rule).alias("rule"))) for s, name, rule in CHECKS if s == section]
    return given.select("config_id", F.explode(F.filter(F.array(*broken), lambda b: b.isNotNull())).alias("b")).select("config_id", "b.setting", "b.rule")


class Settings:
    """Nested settings by dotted names, over the defaults."""

    def __init__(self, values: dict | None = None) -> None:
        self.values = copy.deepcopy(DEFAULTS)
        for section, own in (values or {}).items():
            if isinstance(own, dict) and isinstance(self.values.get(section), dict):
                self.values[section].update(own)
            else:
                self.values[section] = own

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.values, f, indent=2, ensure_ascii=False)

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, dict) or part not in at:
                return default
            at = at[part]
        return at

    def set(self, name: str, value: Any) -> None:
        *path, last = name.split(".")
        at = self.values
        for part in path:
            at = at.setdefault(part, {})
        at[last] = value

    def reset(self) -> None:
        self.values = copy.deepcopy(DEFAULTS)
