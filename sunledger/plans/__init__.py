"""Partitioning plans shared by all operators: bounded chunks instead of whole series."""
