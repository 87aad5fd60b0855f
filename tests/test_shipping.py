"""The zip for the workers holds the package and can be imported."""

import subprocess
import sys
import zipfile

from framelark.shipping import package_zip, ship


def test_zip_imports(tmp_path):
    path = package_zip(str(tmp_path))
    assert "framelark/functions/kernels.py" in zipfile.ZipFile(path).namelist()
    code = "import framelark.functions.kernels as k; print(k.__file__)"
    out = subprocess.run(
        [sys.executable, "-c", code], env={"PYTHONPATH": path}, cwd=str(tmp_path),
        capture_output=True, text=True, check=True)
    assert "framelark.zip" in out.stdout


def test_local_sessions_need_none(spark):
    ship(spark)
