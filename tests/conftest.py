import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from markscale.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def write_lines(tmp_path):
    """Write a folder of text files from ``{name: lines}`` and return its path."""

    def write(**files):
        folder = tmp_path / "in"
        folder.mkdir(exist_ok=True)
        for name, lines in files.items():
            (folder / f"{name}.jsonl").write_text("".join(f"{line}\n" for line in lines), encoding="utf-8")
        return str(folder)

    return write
