"""Queries of the core: each reads whole tables and applies an operator."""
