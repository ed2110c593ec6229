"""Declared schemas of the tables that come from files."""

from __future__ import annotations

PREDICTION = "path string, y_true int, fake_score double"
SUBMISSION_PREDICTION = "id string, y_true int, fraud_score double, label int"
METADATA = "path string, split string, label int, source_label string, caption string"
LABELLED_ID = "id string, image_path string, label int, type string"
CATALOG_ENTRY = (
    "struct<title: string, source: string, ref: string, local_dir: string,"
    " updated: string, size_mb: int, notes: string>"
)
RUN_METRICS = (
    "method string, accuracy double, precision double, recall double, f1 double, roc_auc double,"
    " brier_score double, expected_calibration_error double, n_samples bigint,"
    " selected_feature_names array<string>"
)

# Accepted column names, in order of preference.
ID_COLUMNS = (
    "image_id",
    "id",
    "filename",
    "file_name",
    "image",
    "image_path",
    "file_path",
    "filepath",
    "path",
)
PATH_LIKE_COLUMNS = ("image_path", "file_path", "filepath", "path")
SCORE_COLUMNS = ("fake_score", "prob_fake", "fake_probability", "score", "prediction", "predicted_score")
SAMPLE_ID_COLUMNS = ("id", "image_id", "filename", "file_name", "image_path", "path")
FRAUD_SCORE_COLUMNS = ("fraud_score", "fake_score", "prob_fraud", "prob_fake", "score", "prediction")
LABEL_COLUMNS = ("label", "predicted_label", "target")
