"""Training-data pipeline operators (ten) and their registered queries.

Nothing outside this folder imports it; ``__spark_entry__`` adds its queries
only where it can be imported.
"""
