"""millrace: relational, corpus and streaming operators built on PySpark DataFrames."""
