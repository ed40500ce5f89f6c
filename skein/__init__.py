"""skein: linked-notes retrieval, graph expansion and evaluation as Spark DataFrame operators."""
