"""Training-data operators over documents, pages and embeddings. Nothing else in the library imports this part."""
