"""Reading and writing tables, documents, logs and models."""
