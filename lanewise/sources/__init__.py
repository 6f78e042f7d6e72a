"""Reading and writing: tables, messages, partitioned results, keyed batches."""
