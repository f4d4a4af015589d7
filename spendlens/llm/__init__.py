"""Training-data operators over documents, pages and embeddings.

Each module is one operator with its own interface; ``queries`` binds them to
the driver's tables. Nothing else in the library imports this subpackage.
"""
