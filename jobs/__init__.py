"""Runnable jobs: each takes plain paths and a small JSON file of settings, and puts its work in a function of a session."""
