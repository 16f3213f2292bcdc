"""Column expressions: text normalisation, edit distances, paths/JSON/time,
and the once-per-row bind barrier."""
