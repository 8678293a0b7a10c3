"""Tables in and out, and the catalog of runs."""
