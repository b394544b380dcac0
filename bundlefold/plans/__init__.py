"""Whole jobs: packing, unpacking, estimates, dumps, the workload generator and the benchmark report."""
