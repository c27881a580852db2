import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(autouse=True)
def _other_empty_tables(request):
    """``test_empty_tables`` runs every query, but writes no tables for those over pages and conversations."""
    if getattr(request.node, "originalname", "") == "test_empty_tables":
        spark, tmp_path = request.getfixturevalue("spark"), request.getfixturevalue("tmp_path")
        spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
        spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
