"""Training-data operators on Spark: one module per operator, registered by ``queries``."""
