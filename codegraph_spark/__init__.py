"""A PySpark-native engine for source-code property graphs and, in ``llm``, training-data pipelines."""
