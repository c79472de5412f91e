"""Reading and writing extraction results; the boundary to extraction engines."""
