"""Tables, bulk load and unload, copy-on-write changes, partitions and the catalog."""
