"""Detections and case-level analytics."""
