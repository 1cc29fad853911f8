"""Cleaning, enriching, deduplicating, profiling and comparing large annotation tables with Spark."""
