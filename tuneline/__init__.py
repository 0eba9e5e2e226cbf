"""Spark-native analysis of designed experiments and tuning runs."""

import os

# A task has one core, and a driver that has started a JVM can hang in a linear algebra library of several threads.
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
