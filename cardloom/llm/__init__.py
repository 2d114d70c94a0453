"""Training-data operators: one module for each, thin registered queries in ``queries``."""
