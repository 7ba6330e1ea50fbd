"""The registered queries: every operator on the given tables, each with its SQL twin."""
