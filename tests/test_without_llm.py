import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
PROBE = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 25 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"


def test_library_works_without_llm(tmp_path):
    for with_pipeline in (True, False):
        copy = tmp_path / str(with_pipeline)
        copy.mkdir()
        shutil.copytree(ROOT / "tidemark", copy / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
        for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * with_pipeline]:
            if (ROOT / name).exists():
                shutil.copy(ROOT / name, copy)
        subprocess.run([sys.executable, "-c", PROBE], cwd=copy, check=True)
