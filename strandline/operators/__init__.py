"""Relational operators over trajectories, verification credits, reports and corpora."""
