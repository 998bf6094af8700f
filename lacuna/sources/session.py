"""What a session needs beyond Spark: fresh paths for tables that live as long as the driver, and this package on the executors."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Where scratch tables go if the session names no shared folder (single-machine sessions, tests).
_own: dict[str, str] = {}
_roots: set[str] = set()
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="lacuna-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lacuna_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted((root / "lacuna").rglob("*.py")):
            z.write(p, p.relative_to(root).as_posix())
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder of ``spark.checkpoint.dir``. Where that is unset, a folder of this machine, which only
    a session on one machine can use. What is left there is deleted when the driver ends."""
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="lacuna-scratch-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = f"file://{_own[app]}"
    root = f"{base.rstrip('/')}/lacuna-{app}"
    if root not in _roots:
        _roots.add(root)
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        atexit.register(_remove, path.getFileSystem(spark._jsc.hadoopConfiguration()), path)
    return f"{root}/{label}-{uuid.uuid4().hex}"


def _remove(files, path) -> None:
    try:
        files.delete(path, True)
    except Exception:  # noqa: BLE001 - the driver is ending, and its JVM may be gone
        pass
