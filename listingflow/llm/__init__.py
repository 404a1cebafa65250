"""Training-data operators: packing, filtering, de-duplication, scoring and encoding."""
