"""operators of quarrykit."""
