"""Queries over the derived inspection tables, by kind of operator."""

MODULES = ("scalars", "rules", "aggregates", "windows", "joins", "assignment", "datasets", "files", "inputs", "outputs", "details", "pixels", "vision", "models", "streams")
