import random

import pytest


@pytest.fixture(scope="session")
def rnd():
    return random.Random(7)


FILES = "file_id long, folder string, text string, n long, lines string, node string, size int"


def files(spark, rows):
    """File records with extra columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], FILES)
