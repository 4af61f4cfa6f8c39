"""Relational operators on networks, routes and fronts."""
