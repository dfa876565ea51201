"""Reading and writing: the partitioned store, raw payloads, text columns."""
