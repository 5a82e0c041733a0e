"""Iterative jobs: the loop, its hooks, checkpoints and runners."""
