"""A catalog engine for exported personal media libraries, built from DataFrame operators."""
