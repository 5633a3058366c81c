"""Audit of identifier claims on Spark: mining, resolution, agreement, verdicts, scoring."""
