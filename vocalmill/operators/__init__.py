"""DataFrame operators on segments, spans, turns, library tables and job state."""
