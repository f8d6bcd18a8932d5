"""The registered queries over the standard tables, and their SQL."""
