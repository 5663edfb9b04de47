"""plans of quarrykit."""
