"""Part of pointloom; see the modules."""
