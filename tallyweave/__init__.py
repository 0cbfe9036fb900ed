"""Survey segmentation and cohort analytics as PySpark DataFrame operators."""
