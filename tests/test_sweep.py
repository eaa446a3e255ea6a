"""What a sweep holds at once."""

from seine.sources import tree


def test_a_sweep_holds_few_files(tmp_path, monkeypatch):
    (tmp_path / "sub").mkdir()
    for k in range(50):
        (tmp_path / "sub" / f"{k}.txt").touch()
    monkeypatch.setattr(tree, "CHUNK", 8)
    taken = 0

    def counted():
        nonlocal taken
        for row in tree.walk(str(tmp_path), ordered=False):
            taken += 1
            yield row

    sizes, at = [], []
    for batch in tree._batches(counted()):
        sizes.append(batch.num_rows)
        at.append(taken)
    assert sizes == [8] * 6 + [2] and at[0] == 8
    assert [r[0] for r in tree.walk(str(tmp_path))] == sorted(f"sub/{k}.txt" for k in range(50))
