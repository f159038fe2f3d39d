"""Property-listing ETL, search and recommendation as PySpark jobs."""
