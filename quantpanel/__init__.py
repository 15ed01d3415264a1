"""A Spark engine for cross-sectional time-series factor research and for training-data pipelines."""
