"""sources of quarrykit."""
