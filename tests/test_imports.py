"""Every module loads before a session exists."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_every_module_loads_without_a_session():
    names = [".".join(p.relative_to(ROOT).with_suffix("").parts) for p in sorted((ROOT / "antecede").rglob("*.py"))]
    code = f"import importlib, antecede.checks; antecede.checks.load(); [importlib.import_module(n) for n in {names!r}]"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
