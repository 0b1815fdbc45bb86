"""Scans: the usage ledger, the price catalogue, session logs, inventories and quota readings."""
