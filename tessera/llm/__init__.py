"""Training-data operators: scoring, filtering, deduplication, mixing and
tokenising of document collections.  Nothing else in the library imports
this subpackage."""
