"""Thresholds of the audit in one place; every query takes another Settings."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    """Fixed values of the audit. Distances are of unit vectors."""

    image_dim: int = 512
    face_dim: int = 512
    template_dim: int = 1088
    similarity_threshold: float = 0.92
    dbscan_eps: float = 0.085
    min_samples: int = 2
    abnormal_min_size: int = 2
    hdbscan_epsilon: float = 0.20
    merge_threshold: float = 0.55
    noise_pair_threshold: float = 0.60
    noise_recovery_factor: float = 1.2
    layout_threshold: float = 0.05
    color_weight: float = 0.3
    default_top_k: int = 5
    image_top_k: int = 20
    max_top_k: int = 100
    self_match_distance: float = 0.001
    max_file_bytes: int = 10 * 1024 * 1024
    extensions: tuple[str, ...] = ("jpg", "jpeg", "png", "bmp")
    study_durations: tuple[int, ...] = (2, 3, 4, 5)
    min_enrollment_age: int = 15
    max_enrollment_age: int = 30
    min_face_age: int = 16
    max_face_age: int = 35
    max_tenure: int = 12
    number_similarity: float = 0.85
    face_min_score: float = 0.5
    face_min_side: int = 80
    hamming_threshold: int = 10
    eps_floor: float = 0.03
    eps_ceiling: float = 0.15
    raw_text_limit: int = 10_000
    raw_response_limit: int = 5_000
    fields: tuple[str, ...] = field(
        default=(
            "cert_type",
            "student_name",
            "school",
            "department",
            "principal",
            "grad_year",
            "enrollment_year",
            "issue_year",
            "issue_date",
            "cert_no",
            "student_id_no",
            "gender",
            "birth_year",
            "supervisor",
        )
    )


SETTINGS = Settings()
