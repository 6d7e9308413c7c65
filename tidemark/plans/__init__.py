"""Views and registered queries."""
