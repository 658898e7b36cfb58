"""Whole analyses: operators chained into one lazy plan over all tags."""
