"""tidemark: crawl analytics and corpus processing as PySpark plans."""
