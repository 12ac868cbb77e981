"""Findling: record linkage and analytics for cultural-property data on Spark."""
