"""Dictionary-free CJK text search and text analytics on Spark DataFrames."""

from __future__ import annotations

__version__ = "0.1.0"

_shipped: set[str] = set()


def ship(spark) -> None:
    """Sends this package to the executors once, so that their Python workers find it wherever they run."""
    import tempfile
    import zipfile
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    here = Path(__file__).resolve().parent
    to = Path(tempfile.mkdtemp(prefix="hanagram-"), "hanagram.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, Path("hanagram", p.relative_to(here)).as_posix())
    spark.sparkContext.addPyFile(str(to))
