"""Operators: DataFrame -> DataFrame stages of the discharge pipeline."""
