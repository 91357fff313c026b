"""Timed-text analytics on Spark: cues, timelines, repairs and quality reports for tables of scripts."""
