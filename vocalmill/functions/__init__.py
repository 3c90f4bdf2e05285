"""Column functions: text, times, numbers, media names, metadata."""
