"""Listing folders on the executors against a walk over the same tree."""

from __future__ import annotations

import os

import pytest

from docledger.sources import listing, readers

NAMES = ["a b.pdf", "100%25.pdf", "é ü.png", "#x?.jpg", "no ending", ".pdf", "d.pdf.gz", "e.PDF", "[1].jpeg", "_under.pdf", ".hidden.png"]


@pytest.fixture
def tree(tmp_path):
    """One long path, one wide folder, one folder that holds most files, and empty ones."""
    root = tmp_path / "root"
    deep = root / "inbox" / "/".join(f"level {n}" for n in range(4))
    deep.mkdir(parents=True)
    for name in NAMES:
        (deep / name).write_bytes(b"x" * len(name))
    for n in range(40):
        (root / "inbox" / "wide" / f"f={n}").mkdir(parents=True)
        (root / "inbox" / "wide" / f"f={n}" / "one.pdf").write_bytes(b"1")
    (root / "inbox" / "hot").mkdir()
    for n in range(3000):
        (root / "inbox" / "hot" / f"{n}.png").write_bytes(b"")
    (root / "inbox" / "empty" / "er").mkdir(parents=True)
    (root / "inbox2").mkdir()
    (root / "inbox2" / "not listed.pdf").write_bytes(b"")
    return root


def walked(root, prefix):
    paths = [os.path.join(folder, name) for folder, _, names in os.walk(root / prefix) for name in names]
    return sorted((os.path.relpath(path, root), os.path.getsize(path), int(os.path.getmtime(path))) for path in paths)


@pytest.mark.parametrize("prefix", ["", "inbox", "inbox/", "inbox/hot", "inbox/empty"])
def test_against_a_walk(spark, tree, prefix):
    rows = listing.list_files(spark, str(tree), prefix).collect()
    assert sorted((r.id, r.size, int(r.last_modified.timestamp())) for r in rows) == walked(tree, prefix)


def test_forms_of_a_root(spark, tree):
    for root in (f"file://{tree}", f"file:{tree}", f"{tree}/"):
        assert listing.list_files(spark, root, "inbox/wide").count() == 40


def test_wide_levels_are_dealt_over_tasks(spark, tree, monkeypatch):
    made = []
    monkeypatch.setattr(listing, "work_folder", lambda session, purpose: made.append(str(tree.parent / f"level-{len(made)}")) or made[-1])
    assert listing.list_files(spark, str(tree), "inbox/wide", tasks=8).count() == 40
    written = [[name for name in os.listdir(path) if name.startswith("part-")] for path in made]
    assert len(made) == 2 and len(written[0]) <= 2 and len(written[1]) >= 6


def test_batches_of_a_large_folder(spark, tree, monkeypatch):
    monkeypatch.setattr(listing, "_BATCH", 7)
    batches = list(listing.entries(str(tree), "inbox/hot"))
    assert max(batch.num_rows for batch in batches) == 7 and sum(batch.num_rows for batch in batches) == 3000


def test_missing_and_empty(spark, tmp_path):
    found = readers.scan_inbox(spark, str(tmp_path / "none"))
    assert found.columns == ["id", "name", "mime_type", "size", "last_modified"] and found.collect() == []
    assert listing.list_files(spark, str(tmp_path)).collect() == []


def test_accepted_types(spark, tree):
    found = readers.scan_inbox(spark, str(tree), prefix="inbox/level 0")
    assert sorted(r.name for r in found.collect()) == sorted(set(NAMES) - {"no ending", ".pdf"})
