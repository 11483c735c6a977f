"""kinfold: sequence-family analytics on Spark."""
