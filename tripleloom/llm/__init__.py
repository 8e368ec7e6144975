"""Training-data operators on text.  Optional: nothing outside this subpackage imports it."""
