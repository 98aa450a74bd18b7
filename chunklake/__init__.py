"""chunklake: a versioned file-catalog and corpus analytics engine on PySpark."""
