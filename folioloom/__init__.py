"""Relational analysis of books and other long texts on Spark: segments, casts, attribution, voices and timing."""
