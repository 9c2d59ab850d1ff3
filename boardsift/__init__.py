"""boardsift: incremental listing analytics on Spark DataFrames.

Raw board payloads are normalised to one listing schema, known listings are
dropped, the rest is scored, classified and filtered by rules, and ranked
matches go to an outbox table.
"""
