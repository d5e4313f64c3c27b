"""Feature tables, customer segments, classifiers and batch scoring."""
