"""rankloom: ranked-retrieval and corpus analytics as PySpark DataFrame transforms."""
