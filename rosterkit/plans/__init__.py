"""End-to-end jobs built from the sources and operators."""
