"""Moment retrieval and corpus analytics as DataFrame-to-DataFrame functions."""
