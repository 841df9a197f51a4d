"""Reading and writing documents, predictions, feature weights and metric tables."""
