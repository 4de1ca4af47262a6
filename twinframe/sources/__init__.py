"""Reading loosely typed CSV, row numbering, and the CSV / text sinks."""
