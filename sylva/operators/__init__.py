"""Operators: profiles, sampling, rule candidates, scoring, validation, matrices, prediction."""
