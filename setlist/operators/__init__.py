"""Operators on DataFrames: roll-up, aliases, blocking, scoring, matching, layout, responses."""
