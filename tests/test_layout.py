"""The package without its optional part."""

import ast
import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def imported(path):
    with open(path) as file:
        for node in ast.walk(ast.parse(file.read())):
            if isinstance(node, ast.Import):
                yield from (a.name for a in node.names)
            elif isinstance(node, ast.ImportFrom):
                yield from (f"{node.module}.{a.name}" for a in node.names)


def test_nothing_else_imports_the_optional_part():
    for folder, _, names in os.walk(os.path.join(ROOT, "rastra")):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    assert not any(x.startswith("rastra.llm") for x in imported(os.path.join(folder, name))), name


def test_the_entry_module_works_without_it(tmp_path):
    shutil.copytree(os.path.join(ROOT, "rastra"), tmp_path / "rastra", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert q and set(s) <= set(q) and not any(x.startswith('op') for x in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
