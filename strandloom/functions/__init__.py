"""Column functions over sequences, qualities and hits; vectorised functions where SQL has no words."""
