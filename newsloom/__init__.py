"""newsloom: text-radar analytics and training-data operators on PySpark."""
