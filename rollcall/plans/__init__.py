"""Registered queries: operators wired to the driver tables, each with its SQL counterpart."""
