"""Configurations and alignment plans; no Spark job starts here."""
