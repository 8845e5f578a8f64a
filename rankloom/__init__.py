"""rankloom: ranked-retrieval evaluation and corpus preparation as PySpark jobs."""
