"""Detection and segmentation analytics as Spark jobs."""
