"""Operators on data frames: keys, alignment, differences, validation, profiles, matching."""
