"""The package itself for Python workers that could not import it otherwise."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from siltstone.errors import InvalidConfiguration

_SHIPPED: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only local mode may do with a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.startswith("local"):
        raise InvalidConfiguration("spark_checkpoint_dir_is_not_set")
    return (named or tempfile.mkdtemp(prefix="siltstone-")).rstrip("/")


def ship(spark: SparkSession) -> None:
    """Once for each application: put the package in the shared folder, from where executors fetch it."""
    from siltstone.sources.files import Folder

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(root.rglob("*.py")):
            archive.write(path, f"{root.name}/{path.relative_to(root)}")
    base = shared_folder(spark)
    base = base if ":" in base else f"file://{base}"
    name = f"siltstone-{uuid.uuid4().hex}.zip"
    Folder(spark, base).write(name, data.getvalue())
    spark.sparkContext.addPyFile(f"{base.rstrip('/')}/{name}")
    _SHIPPED.add(app)
