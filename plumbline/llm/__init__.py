"""Operators for preparing training text: encoding, copies, shards, scans, search, packing, languages."""
