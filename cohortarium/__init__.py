"""A Spark-native engine for declarative patient-cohort definitions."""
