"""Training-data operators over document, label and conversation tables, and their queries."""
