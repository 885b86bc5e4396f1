"""A PySpark-native engine for time-valid facts, text fidelity and audits."""
