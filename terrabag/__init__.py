"""Spark-native distribution regression for bags of spatial cells."""
