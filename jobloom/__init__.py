"""Batch and streaming jobs for job-market web data on Spark."""
