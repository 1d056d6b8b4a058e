"""Lectern: bilingual corpus preparation, checking and management on Spark."""
