"""Correctness harness: telemetry projected from the test tables, the registered
queries over it, and an independent SQL statement for each."""
