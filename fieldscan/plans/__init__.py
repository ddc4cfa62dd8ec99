"""Compositions of operators into whole analyses, and the registered queries."""
