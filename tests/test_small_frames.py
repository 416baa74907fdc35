"""Many small frame files are dealt to several tasks and read in batches."""

import numpy as np

from lumenfold.sources import pictures, png


def test_small_files_make_several_partitions_and_few_batches(tmp_path):
    (tmp_path / "clip1").mkdir()
    for k in range(2500):
        (tmp_path / "clip1" / f"frame_{k:06d}.png").write_bytes(png.encode(np.full((2, 2), k % 251, np.uint8)))
    reader = pictures._FrameReader(str(tmp_path), 1, pictures.SPLIT_BYTES)
    parts = reader.partitions()
    assert len(parts) == 3 and sorted(f[1] for p in parts for f in p.found) == list(range(2500))
    batches = [b for p in parts for b in reader.read(p)]
    assert len(batches) < 20
    rows = [(i, px) for b in batches for i, px in zip(b.column("frame_idx").to_pylist(), b.column("pixels").to_pylist())]
    assert rows == [(k, bytes([k % 251] * 4)) for k in range(2500)]
