"""Compositions of the operators: cleaning, report, dashboard and jobs."""
