"""A member whose first read fails is read by itself; one that stays unreadable is reported."""

import pytest

from attesta.llm import media


class Flaky:
    """A file system whose archives can't be read ``bad`` times."""

    def __init__(self, fs, bad):
        self.fs, self.bad = fs, bad

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def open_input_file(self, path):
        f = self.fs.open_input_file(path)
        return Handle(self, f) if path.endswith(".tar") else f


class Handle:
    def __init__(self, owner, f):
        self.owner, self.f = owner, f

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.f.close()

    def read_at(self, *at):
        if self.owner.bad:
            self.owner.bad -= 1
            raise OSError("lost")
        return self.f.read_at(*at)


@pytest.mark.parametrize("bad, lost", [(1, 0), (3, 1), (1000, 3)])
def test_lost_reads(spark, tmp_path, monkeypatch, bad, lost):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(3)], "doc_id long, text string").coalesce(1)
    media.write_archives(df, f"file://{tmp_path}/a", "text", "doc_id")
    fs, inner = media.open_fs(f"file://{tmp_path}/a")
    flaky = Flaky(fs, bad)
    monkeypatch.setattr(media, "open_fs", lambda uri: (flaky, inner))
    reader = media.ArchiveReader({"path": f"file://{tmp_path}/a", "tries": "2", "onerror": "report"})
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert len(rows) == 3 and sum(r["media"] is None and r["error"] is not None for r in rows) == lost
