"""graphloom: code-fact analytics and training-data operators on PySpark."""
