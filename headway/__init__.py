"""Rail-disruption analytics and training-data preparation as Spark jobs."""
