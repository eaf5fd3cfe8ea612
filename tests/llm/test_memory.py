"""What a Python worker still holds after a step that took much memory: workers live on while others work."""

import re

import numpy as np
import pytest

from tests.conftest import SMALL

common = pytest.importorskip("tokenguard.llm.common")
P = pytest.importorskip("corpus_pipeline")


def held() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"\nAnonymous:\s+(\d+)", f.read())[1]) / 1024


def test_freed_memory_goes_back():
    kept = [np.ones(12_000) for _ in range(2000)]  # 190 MB in pieces that glibc keeps for itself
    last = kept[-1]
    full = held()
    del kept
    common.give_back()
    assert held() < full - 150 and last.sum() == 12_000


@pytest.mark.parametrize("stage", [0, 1, 4])
def test_python_stages_give_back(spark, monkeypatch, stage, tmp_path):
    """Each task of the last step of these stages ends with its memory given back."""
    from tokenguard.llm import bpe, exchange, language, ngram_join

    said = tmp_path / "said"

    def noted(path=str(said)):
        with open(path, "a") as f:
            f.write("x")

    for module in (bpe, exchange, language, ngram_join):
        monkeypatch.setattr(module, "give_back", noted)
    P.STAGES[stage][1](spark, spark.read.parquet(f"{SMALL}/documents.parquet"), SMALL).collect()
    assert said.exists() and said.stat().st_size
