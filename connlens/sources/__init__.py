"""Tables, row selections and record extracts."""
