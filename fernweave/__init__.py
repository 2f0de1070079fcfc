"""PySpark-native analytics over code repositories: every operator is a DataFrame plan."""
