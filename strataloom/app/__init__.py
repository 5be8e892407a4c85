"""Facades over the operators: an engine, a memory gateway and command lines."""
