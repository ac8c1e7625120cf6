"""Count matrices from ordinary tables, and seeded simulators."""
