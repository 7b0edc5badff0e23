"""Readers: landed venue payloads and stored tables to typed DataFrames.

Every parser returns its good rows and keeps the bad ones as rows with a
reason, so a malformed payload is never mistaken for an empty one.
"""
