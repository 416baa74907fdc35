"""The jobs and their tests stand without the corpus operators."""

import pathlib
import re

ROOT = pathlib.Path(__file__).parents[2]


def test_jobs_import_nothing_of_them():
    for f in [*(ROOT / "jobs").glob("*.py"), *(ROOT / "tests" / "jobs").glob("*.py")]:
        assert not re.search(r"^\s*(import|from)\s+.*(\bllm\b|corpus_pipeline)", f.read_text(), re.M), f
