"""Training-data operators: thirteen methods over documents, pages, benchmark items and dialogues."""
