"""Readers, staging, report files, synthetic tables."""
