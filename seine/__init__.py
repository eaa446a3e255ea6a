"""seine: an indexed text-search engine and training-data toolkit on PySpark."""
