"""Pipelines composed of operators: scores, calibration, simulation, rating."""
