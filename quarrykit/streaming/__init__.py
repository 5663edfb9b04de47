"""streaming of quarrykit."""
