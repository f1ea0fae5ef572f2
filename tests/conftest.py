from __future__ import annotations

import json
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from sellerlens.session import local_session  # noqa: E402
from sellerlens.sources import feeds  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, memory="8g", app="sellerlens-tests")
    yield session
    session.stop()


@pytest.fixture
def land(spark, tmp_path):
    """Write objects as a landed feed (one JSON file per chunk) and read it back."""

    def write(feed: str, *chunks: list[dict]):
        folder = tmp_path / feed
        folder.mkdir(exist_ok=True)
        for i, chunk in enumerate(chunks):
            text = "\n".join(json.dumps(o, ensure_ascii=False) for o in chunk)
            (folder / f"chunk-{i:03d}.json").write_text(text, encoding="utf-8")
        return feeds.read_feed(spark, feed, str(folder))

    return write


def rows(df, *columns, order=None):
    df = df.select(*columns) if columns else df
    out = [tuple(r) for r in df.collect()]
    return out if order is False else sorted(out, key=lambda t: tuple((v is None, v if v is not None else 0) for v in t))
