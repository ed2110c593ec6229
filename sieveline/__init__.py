"""Detector evaluation on Spark: metrics, thresholds, fusion, audits and packaging as DataFrame operators."""
