"""Test binding: staging of the driver's tables, one query and one oracle per operator."""
