"""millrace: catalog enrichment analytics and corpus operators on PySpark."""
