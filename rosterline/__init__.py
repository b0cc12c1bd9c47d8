"""Registry, record-linkage and release analytics as Spark DataFrame transformations."""
