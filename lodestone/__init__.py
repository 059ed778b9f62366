"""Record linkage, panel and corpus operators for PySpark."""
