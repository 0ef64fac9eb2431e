from __future__ import annotations

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


MASK = (1 << 64) - 1


def sample_vector(seed: int, dim: int) -> list[float]:
    """Deterministic components in [-1, 1): a splitmix64 sequence, 24 bits each."""
    golden, a, b = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # fixed values of the generator
    state, out = (seed + golden) & MASK, []
    for _ in range(dim):
        state = (state + golden) & MASK
        z = state
        z = ((z ^ (z >> 30)) * a) & MASK
        z = ((z ^ (z >> 27)) * b) & MASK
        z ^= z >> 31
        out.append(float(np.float32(np.float32(z >> 40) / np.float32(1 << 24)) * np.float32(2) - np.float32(1)))
    return out


@pytest.fixture
def vec():
    return sample_vector
