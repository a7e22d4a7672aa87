"""Functions in Java for what Python is too slow for: compiled in the driver by the compiler that Spark generates code with, and sent to executors as a jar by Spark itself."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

_NAME, _CLASS = "tagloom_changed_ranges", "tagloom.ChangedRanges"
RANGES = "array<struct<s: int, e: int>>"


def _jar(spark: SparkSession) -> str:
    compiler = spark.sparkContext._jvm.org.codehaus.janino.SimpleCompiler()
    with open(os.path.join(os.path.dirname(__file__), "ChangedRanges.java"), encoding="utf-8") as f:
        compiler.cook(f.read())
    path = os.path.join(tempfile.mkdtemp(prefix="tagloom-"), f"tagloom-{uuid.uuid4()}.jar")
    with zipfile.ZipFile(path, "w") as z:
        for name, code in dict(compiler.getBytecodes()).items():
            z.writestr(name.replace(".", "/") + ".class", bytes(code))
    return path


def changed_ranges(spark: SparkSession) -> Callable[[Column, Column], Column]:
    """``changed_ranges`` of ``diffs`` as a function of two columns."""
    if not spark.catalog.functionExists(_NAME):
        spark.sql(f"ADD JAR '{_jar(spark)}'")
        session = spark._jsparkSession
        made = session.sharedState().jarClassLoader().loadClass(_CLASS).newInstance()
        session.udf().register(_NAME, made, spark._jvm.org.apache.spark.sql.types.DataType.fromDDL(RANGES))
    return lambda old, new: F.call_function(_NAME, old, new)
