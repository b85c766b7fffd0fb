"""One module per registered query."""
