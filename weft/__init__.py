"""weft: multi-way equi-join pipelines and training-data operators on PySpark."""
