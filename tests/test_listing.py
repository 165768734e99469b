"""Trees of files: circles of links, policies, and wide levels."""

import os

import pytest

from plumbline.sources import listing


def test_tree(spark, tmp_path):
    root = tmp_path / "root"
    for i in range(130):  # a level of more directories than one task lists
        (root / f"d{i:03}").mkdir(parents=True)
        (root / f"d{i:03}" / "f.txt").write_text("x" * i)
    (root / "d000" / "deep" / "er").mkdir(parents=True)
    (root / "d000" / "deep" / "er" / "g.txt").write_text("g")
    (tmp_path / "outside").mkdir()
    (tmp_path / "outside" / "o.txt").write_text("o")
    os.symlink(root, root / "d001" / "circle")
    os.symlink(tmp_path / "outside", root / "d002" / "out")
    os.symlink(root / "d003" / "f.txt", root / "same.txt")
    os.symlink("nowhere", root / "broken")
    os.symlink("self", root / "self")
    (root / "vendor").mkdir()
    (root / "vendor" / "v.txt").write_text("v")
    own = {f"d{i:03}/f.txt" for i in range(130)} | {"d000/deep/er/g.txt"}
    got = {r.path: r.size for r in listing.tree(spark, f"file://{root}", ignored=("vendor",)).collect()}
    # the file of d003 is nearest to the root by its link
    assert set(got) == own - {"d003/f.txt"} | {"same.txt", "d002/out/o.txt"} and got["d100/f.txt"] == 100
    assert {r.path for r in listing.tree(spark, str(root), links="skip").collect()} == own | {"vendor/v.txt"}
    with pytest.raises(Exception, match="symbolic link"):
        listing.tree(spark, str(root), links="error")
    with pytest.raises(ValueError, match="no such policy"):
        listing.tree(spark, str(root), links="maybe")
