"""Registered queries: each reference operator over the test tables, with its SQL oracle."""
