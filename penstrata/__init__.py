"""Writing-style analytics over document collections, as DataFrame operators."""
