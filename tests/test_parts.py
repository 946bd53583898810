"""Tables of parts: commits, replays, kills, and parts that come and go."""

import glob

import pytest
from pyspark.sql import functions as F

from helpers import plan
from tremorlake.schemas import table
from tremorlake.sources import parts

ROWS = table("k bigint, v string")


def _rows(spark, values):
    return spark.createDataFrame(values, table("k bigint, v string, part string"))


def _all(spark, path, chosen=None):
    known = parts.manifest(spark, path)
    return sorted(tuple(r) for r in parts.read(spark, path, ROWS, known, chosen).select(
        "part", "k", "v").collect())


def test_commits_replace_whole_parts(spark, tmp_path):
    path = str(tmp_path / "t")
    assert parts.manifest(spark, path).version == -1 and _all(spark, path) == []
    first = parts.commit(_rows(spark, [(1, "a", "09"), (2, "b", "09"), (3, "c", "10")]), path,
                         parts.manifest(spark, path), 0, ["09", "10"], {"n": 3},
                         {"most": F.max("k")})
    assert first.stats == {"09": {"rows": 2, "most": 2}, "10": {"rows": 1, "most": 3}}
    known = parts.manifest(spark, path)
    assert (known.version, known.stats, known.totals) == (0, first.stats, {"n": 3})
    # A part is rewritten from its own rows, one is new, one is left as it is.
    old = parts.read(spark, path, ROWS, known, ["09"])
    parts.commit(old.unionByName(_rows(spark, [(4, "d", "09"), (5, "e", "11")])), path, known, 1,
                 ["09", "11"], {"n": 5}, {"most": F.max("k")})
    assert _all(spark, path) == [("09", 1, "a"), ("09", 2, "b"), ("09", 4, "d"), ("10", 3, "c"),
                                 ("11", 5, "e")]
    assert _all(spark, path, ["10", "none"]) == [("10", 3, "c")]
    text = plan(parts.read(spark, path, ROWS, parts.manifest(spark, path), ["10"]))
    assert "PartitionFilters" in text and "10" in text.split("PartitionFilters")[1]
    # A touched part without rows is gone, and may come back.
    known = parts.manifest(spark, path)
    parts.commit(_rows(spark, []), path, known, 2, ["10"])
    assert {r[0] for r in _all(spark, path)} == {"09", "11"}
    parts.commit(_rows(spark, [(9, "z", "10")]), path, parts.manifest(spark, path), 3, ["10"])
    assert ("10", 9, "z") in _all(spark, path)
    assert parts.manifest(spark, path).totals == {"n": 5}
    for k in range(4, 12):
        parts.commit(_rows(spark, [(k, "y", "09")]), path, parts.manifest(spark, path), k, ["09"])
    assert len(glob.glob(f"{path}/data/part=09/slot=*")) == 2
    assert len(glob.glob(f"{path}/manifest/turn=*")) == 2


def test_a_killed_commit_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    parts.commit(_rows(spark, [(1, "a", "x"), (2, "b", "y")]), path, parts.Manifest(), 0, ["x", "y"])
    before, known = _all(spark, path), parts.manifest(spark, path)
    create = type(spark).createDataFrame

    def killed(session, data, schema=None, *rest, **more):
        if schema == parts._MANIFEST:
            raise RuntimeError("killed")
        return create(session, data, schema, *rest, **more)

    monkeypatch.setattr(type(spark), "createDataFrame", killed)
    new = create(spark, [(7, "n", "x"), (8, "m", "z")], table("k bigint, v string, part string"))
    with pytest.raises(RuntimeError, match="killed"):
        parts.commit(new, path, known, 1, ["x", "z"])
    monkeypatch.undo()
    assert _all(spark, path) == before
    parts.commit(_rows(spark, [(7, "n", "x")]), path, parts.manifest(spark, path), 1, ["x"])
    assert _all(spark, path) == [("x", 7, "n"), ("y", 2, "b")]
