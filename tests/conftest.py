import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from framelark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def make_frames(spark):
    """Frames of {utt: 2-D array}."""
    def make(series, partitions=3):
        rows = [
            (utt, i, [float(v) for v in row])
            for utt, x in series.items() for i, row in enumerate(x)
        ]
        return spark.createDataFrame(
            rows, "utt string, frame_ix int, feats array<double>"
        ).repartition(partitions)

    return make


@pytest.fixture
def collect():
    """{utt: 2-D array} of frames, checked to be numbered 0, 1, .."""
    import numpy as np

    def gather(frames):
        out = {}
        for r in frames.select("utt", "frame_ix", "feats").orderBy("utt", "frame_ix").collect():
            rows = out.setdefault(r["utt"], [])
            assert r["frame_ix"] == len(rows)
            rows.append(r["feats"])
        return {k: np.array(v, dtype=float) for k, v in out.items()}

    return gather
