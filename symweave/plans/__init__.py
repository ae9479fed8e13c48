"""Ready-made query plans and the tool-style query API."""
