"""Column expressions: calendar, weather and display."""
