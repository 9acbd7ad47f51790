"""tracemill: signal segmentation analytics as Spark jobs."""
