"""Code-review analytics on Spark: diffs and sources to findings, graphs and metrics."""
