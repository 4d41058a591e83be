"""Fitting a subword model gives back the memory that it took."""

import subprocess
import sys
from pathlib import Path

import pytest

FIT = r"""
import re
from pathlib import Path

import numpy as np
import pyarrow as pa

from siftwright.llm.subword import Shape, train


def held():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024


random = np.random.default_rng(1)
words = np.array([random.bytes(k % 5 + 4).hex() for k in range(4000)])
texts = pa.array([" ".join(random.choice(words, 300)) for _ in range(3000)])
train(texts.slice(0, 60), [0, 1] * 30, Shape(epochs=1))
before = held()
model = train(texts, [0, 1] * 1500, Shape(epochs=1))
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory can't be read here")
def test_a_fit_leaves_no_memory_behind():
    ran = subprocess.run([sys.executable, "-c", FIT], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=300)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 25, f"{ran.stdout.strip()} MB stay"
