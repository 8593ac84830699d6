"""Registered queries: an operator applied to whole tables, with its SQL twin."""
