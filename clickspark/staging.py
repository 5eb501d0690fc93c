"""Intermediate tables in the shared folder named by ``spark.checkpoint.dir``.

``stage_table`` writes a frame once as Parquet and reads it back: one job,
columnar, and a lost executor costs a re-read, not a recomputation.  A staged
table has one owner: the innermost ``staging`` scope open where it was made
(scopes are per thread of control, so jobs running side by side do not see
each other's; threads that a job starts join its scope through ``in_scope``),
or else the application.  Owners remove their tables when they end: a scope at
its close, the application just before its context stops, while the file
system can still be reached."""

from __future__ import annotations

import atexit
import contextlib
import contextvars
import uuid
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clickspark.session import ensure_checkpoint_dir

_SCOPE: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("staging_scope", default=None)
_OWNED: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared checkpoint folder; an error where none is set."""
    root = ensure_checkpoint_dir(spark)
    if not root:
        raise ValueError("spark.checkpoint.dir is not set: the library keeps intermediate tables in "
                         "that shared folder; set it to storage that every executor can reach")
    return root.rstrip("/")


def shared_folder(spark: SparkSession, kind: str = "clickspark_tables") -> str:
    """A folder of this application under the shared checkpoint folder."""
    folder = f"{shared_root(spark)}/{kind}/{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        _OWNED[folder] = spark
        _release_before_stop(spark)
    return folder


def _release_before_stop(spark: SparkSession) -> None:
    """Have the context remove the application's tables before it stops."""
    sc = spark.sparkContext
    if getattr(sc, "_clickspark_releases", False):
        return
    stop = sc.stop

    def release_and_stop() -> None:
        if sc._jsc is not None:  # stopping twice is allowed
            release(sc.applicationId)
        stop()

    sc.stop, sc._clickspark_releases = release_and_stop, True
    atexit.register(release, sc.applicationId)  # a program that ends without stop()


def new_path(spark: SparkSession, kind: str = "clickspark_tables") -> str:
    """A fresh path under the shared folder, owned by the open scope."""
    path = f"{shared_folder(spark, kind)}/{uuid.uuid4().hex}"
    scope = _SCOPE.get()
    if scope is not None:
        scope.append(path)
    return path


def stage_table(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once and cut its lineage (see the module docstring).
    A shared folder is required; without one this raises ``ValueError``."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextlib.contextmanager
def staging(spark: SparkSession):
    """Tables staged inside the block are removed at its end; results that
    must outlive it have to be written before."""
    scope: list[str] = []
    token = _SCOPE.set(scope)
    try:
        yield
    finally:
        _SCOPE.reset(token)
        for path in scope:
            remove(spark, path)


def in_scope(fn: Callable) -> Callable:
    """``fn`` for another thread, with the scope that is open here."""
    scope = _SCOPE.get()

    def run(*args, **kwargs):
        token = _SCOPE.set(scope)
        try:
            return fn(*args, **kwargs)
        finally:
            _SCOPE.reset(token)

    return run


def release(application: str) -> None:
    """Remove what an application of this process still holds; what cannot be
    removed is named in a warning."""
    for folder, spark in list(_OWNED.items()):
        if not folder.endswith(f"/{application}"):
            continue
        _OWNED.pop(folder)
        try:
            remove(spark, folder)
        except Exception as e:
            warnings.warn(f"staged tables left in {folder}: {e}", RuntimeWarning, stacklevel=2)
