"""Registered queries: fixtures wired to operators, each with an independent SQL statement of the same result."""
