"""Make the package importable by Python workers.

Functions handed to ``mapInPandas`` are pickled by reference to this
package, so executors must be able to import it.  On a cluster the package
is installed on the executors (or passed with ``--py-files``); nothing is
written to machine-local folders.  In local mode (executors share the
driver's file system) a zip of the package is added once per application
with ``addPyFile``, so scripts run from any working directory.
"""

from __future__ import annotations

import os
import tempfile
import threading
import zipfile

_SHIPPED: set = set()
_LOCK = threading.Lock()


def ship_package(spark) -> None:
    with _LOCK:
        _ship(spark)


def _ship(spark) -> None:
    sc = spark.sparkContext
    ident = sc.applicationId
    if ident in _SHIPPED:
        return
    if not str(sc.master).startswith("local"):
        _SHIPPED.add(ident)                 # cluster: the package is installed on executors
        return
    pkg = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(pkg)
    path = os.path.join(tempfile.mkdtemp(prefix="synthaudit-pyfiles-"), "synthaudit.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _dirs, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(ident)
