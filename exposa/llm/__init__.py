"""Training-data pipeline operators: one module per operator, registered in ``queries``."""
