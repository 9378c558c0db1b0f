"""End-to-end plans: files to store, questions to answers."""
