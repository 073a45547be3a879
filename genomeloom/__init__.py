"""Comparative genomics as Spark jobs: functions from DataFrames to DataFrames."""
