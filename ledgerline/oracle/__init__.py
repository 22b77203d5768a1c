"""Independent SQL statements that check the registered queries."""
